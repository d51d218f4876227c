"""Personal data and terms that disclose it, in DataFrame functions only.

E-mail addresses, IP addresses, card and phone numbers are found by pattern; each
value is a protected entity.  From the corpus, a term's disclosure of an entity is
the pointwise mutual information of both as a share of the entity's information
content: PMI(e; t) / IC(e) = 1 + log P(e | t) / IC(e), from the numbers of texts
(distinct pairs of doc_id and text) that hold e, t and both.  P(e | t) counts one unseen text more that has the
term alone, so that an entity of any frequency is judged and a term seen once tells
less than one seen always and only with it.  In texts that hold the entity, terms
above one threshold are generalised and above a higher one removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE, before, broadcast_if_small, let, pick, slices, write_table

#: Patterns of the kinds, in the order in which equal starts are listed.  They match
#: what ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`` and so on match, but never
#: try a start inside a run again (a match begins at a run's start or where the last
#: one ended), so a long run takes linear time.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts that do not contain this have no match.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": "+"}
_ORDER = list(KINDS)

_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Disclosure:
    generalise: float = 0.9
    remove: float = 0.97
    #: Unseen texts with the term and without the entity.
    unseen: float = 1.0


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _located(text: Column, pattern: Column, order: Column | int, kind: Column | str) -> Column:
    """Spans of all matches of ``pattern``: what lies between matches tells where they are."""
    order, kind = (F.lit(x) if not isinstance(x, Column) else x for x in (order, kind))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def spans(x: Column) -> Column:
        moves = F.zip_with(x["hits"], F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        at = before(F.transform(moves, lambda m: m["gap"] + F.length(m["hit"])), lambda p, q: p + q)

        def span(m: Column, before: Column) -> Column:
            start = before + m["gap"]
            return F.struct(start.alias("start"), order.alias("ord"), (start + F.length(m["hit"])).alias("end"), kind.alias("kind"), m["hit"].alias("value"))

        return F.zip_with(moves, at, span).cast(_SPAN)

    return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), spans)


def base_spans(text: Column) -> Column:
    """All valid spans of the four kinds by start and kind; empty for null. Ends are exclusive, in code points."""
    none = F.array().cast(_SPAN)
    parts = []
    for i, (kind, pattern) in enumerate(KINDS.items()):
        hint = F.instr(text, _HINTS[kind]) > 0 if len(_HINTS[kind]) == 1 else text.rlike(_HINTS[kind])
        parts.append(F.when(hint, F.filter(_located(text, F.lit(pattern), i, kind), partial(_valid_span, kind))).otherwise(none))
    return F.coalesce(F.array_sort(F.concat(*parts)), none)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]", ""))
    return F.concat_ws(":", span["kind"], value)


_WORD = r"[\p{L}][\p{L}\p{M}'-]+"


def _hashed(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(text: Column) -> Column:
    """Hashes of the distinct words, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), _hashed))


def _spelled(text: Column, base: Column, pieces: Column, sizes: tuple[int, ...]) -> Column:
    """``text[at:start] + mark`` of all pieces; ``text`` begins at ``base``.  It is cut into blocks first, so that no piece is sought from its begin."""
    if not sizes:
        return F.array_join(F.transform(pieces, lambda s: F.concat(F.substring(text, s["at"] - base + 1, s["start"] - s["at"]), s["mark"])), "")

    def block(c: Column) -> Column:
        low = c[0]["at"]
        part = F.struct(F.substring(text, low - base + 1, F.element_at(c, -1)["start"] - low).alias("text"), low.alias("low"), c.alias("pieces"))
        return let(part, lambda x: _spelled(x["text"], x["low"], x["pieces"], sizes[1:]))

    return F.array_join(F.transform(slices(pieces, sizes[0]), block), "")


def _replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with ``mark`` for each span; of overlapping spans the first counts and what they cover goes."""

    def pieces(x: Column) -> Column:
        at = before(F.transform(x, lambda s: s["end"]), lambda p, q: F.greatest(p, q))
        made = F.zip_with(x, at, lambda s, a: F.struct(a.alias("at"), s["start"].alias("start"), mark(s).alias("mark")))
        return F.filter(made, lambda s: s["start"] >= s["at"])

    head = let(let(spans, pieces), lambda p: _spelled(text, F.lit(0), p, (32 * SLICE, SLICE)))
    return F.concat(head, F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))


def disclosing_terms(spark: SparkSession, docs: DataFrame, found: DataFrame, how: Disclosure) -> DataFrame:
    """entity, term, disclosure of the pairs that reach the lower threshold; terms and entities are hashes.

    ``found`` has text_hash, entities and words, those of the whole text outside of
    entities, of each distinct text that holds an entity.  All counts are of distinct
    (doc_id, text) of the corpus.  Entities of the same texts are one here (``entity`` is their
    common name), so a text of many entities does not multiply its words with them.
    """
    seen = found.select("text_hash", F.explode("entities").alias("value"))
    names = seen.groupBy("value").agg(F.count(F.lit(1)).alias("n_entity"), F.bit_xor(F.xxhash64("text_hash", F.lit(1))).alias("p"), F.bit_xor(F.xxhash64("text_hash", F.lit(2))).alias("q"))
    names = names.select("value", "n_entity", F.xxhash64("p", "q", "n_entity").alias("entity"))
    held = write_table(spark, seen.join(names, "value").select("text_hash", "entity", "n_entity").distinct(), "entities")
    pairs = held.join(found.select("text_hash", F.explode("words").alias("term")), "text_hash")
    pairs = write_table(spark, pairs.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_both")), "entity-terms")
    texts = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("text_hash"), "text")
    copies = write_table(spark, texts.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    # A text of k copies counts 1 / k in each.
    once = texts.join(broadcast_if_small(copies), "text_hash", "left").select(_terms(F.col("text")).alias("words"), F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("share"))
    counts = once.select(F.explode("words").alias("term"), "share").groupBy("term").agg(F.round(F.sum("share")).alias("n_term"))
    total = float(texts.select("text_hash").distinct().count())
    content = -F.log2(F.col("n_entity") / F.lit(total))
    told = F.log2(F.col("n_both") / (F.col("n_term") + F.lit(how.unseen)))
    judged = pairs.join(counts, "term").withColumn("disclosure", F.when(content > 0, 1 + told / content).otherwise(0.0))
    risky = judged.where(F.col("disclosure") >= how.generalise).select("entity", "term", "disclosure")
    return held.select("text_hash", "entity").join(risky, "entity").select("text_hash", "entity", "term", "disclosure")


def find(spark: SparkSession, docs: DataFrame, how: Disclosure = Disclosure()) -> tuple[DataFrame, DataFrame]:
    """(rows, marked): base spans of every row, and the disclosing terms of the texts that have some.

    ``rows``: doc_id, text_hash, base.  ``marked``: one row for each text_hash with
    ``terms``, an array of struct(term, remove), of hashed terms.  text_hash is of
    doc_id and text.
    """
    docs = pick(docs, ["doc_id", "text"])
    spans = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"), "text", base_spans(F.col("text")).alias("base"))

    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(_entity(s))))
    words = F.when(F.size("base") > 0, _terms(_replaced(F.col("text"), F.col("base"), lambda s: F.lit(" ")))).otherwise(F.array().cast("array<bigint>"))
    rows = write_table(spark, spans.select("doc_id", "text_hash", "base", entities.alias("entities"), words.alias("words")), "base-spans")
    found = write_table(spark, rows.where(F.size("base") > 0).select("text_hash", "entities", "words").dropDuplicates(["text_hash"]), "found")
    risky = disclosing_terms(spark, docs, found, how)
    marks = risky.groupBy("text_hash", "term").agg(F.max("disclosure").alias("d"))
    marked = marks.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("d") >= how.remove).alias("remove")))).alias("terms"))  # words of one text
    return rows.drop("entities", "words"), write_table(spark, marked, "marked")


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of whole words that are marked terms, of kind ``term``; ``value`` says remove or generalise."""
    gone = F.transform(F.filter(terms, lambda t: t["remove"]), lambda t: t["term"])
    mild = F.transform(F.filter(terms, lambda t: ~t["remove"]), lambda t: t["term"])

    def named(x: Column) -> Column:
        words = _located(text, F.lit(_WORD), len(KINDS), "term")
        what = lambda s: F.when(F.array_contains(x["mild"], _hashed(s["value"])), "generalise").when(F.array_contains(x["gone"], _hashed(s["value"])), "remove").otherwise("")
        told = F.transform(words, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"], what(s).alias("value")).cast(_SPAN[6:-1]))
        return F.filter(told, lambda s: s["value"] != "")

    return let(F.struct(gone.alias("gone"), mild.alias("mild")), named)


def _marked_texts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """h, terms: the spans of each distinct text that has marked terms; the others stay where they are."""
    marked = broadcast_if_small(marked.withColumnsRenamed({"text_hash": "h", "terms": "words"}))
    texts = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("text_hash"))
    hit = texts.join(marked, texts["text_hash"] == marked["h"]).dropDuplicates(["h"])
    return hit.select("h", _term_spans(F.col("text"), F.col("words")).alias("terms"))


def report(spark: SparkSession, docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for each row of ``docs``.

    Null and empty texts have no spans (the digest of the empty string); very long
    texts are searched whole, in time that grows with their length; repeated rows are
    reported each, and rows of one doc_id and text count once in the corpus counts; an empty table
    gives no rows; other columns are not read.  Equal starts are listed by kind.
    """
    rows, marked = find(spark, docs, how)
    terms = broadcast_if_small(write_table(spark, _marked_texts(docs, marked), "term-spans"))
    out = rows.join(terms, rows["text_hash"] == terms["h"], "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_sort(F.concat(F.col("base"), F.coalesce("terms", F.array().cast(_SPAN))))
    return out.select("doc_id", *[count(k) for k in _ORDER], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def _sign(s: Column) -> Column:
    return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "remove", "").otherwise("[TERM]")


def sanitise(spark: SparkSession, docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with all its columns; in ``text`` entities become ``[KIND]`` and terms ``[TERM]`` or nothing.

    ``n_chars``, where there is one, follows the text.  Rows without spans, null and
    empty texts are unchanged; repeated rows change alike and all stay; very long
    texts take time in proportion; an empty table gives no rows; other columns may
    have any name but ``__h``, ``__terms`` and ``__spans``.
    """
    _, marked = find(spark, docs, how)
    terms = broadcast_if_small(write_table(spark, _marked_texts(docs, marked), "term-spans").withColumnsRenamed({"h": "__h", "terms": "__terms"}))
    out = docs.join(terms, F.xxhash64(docs["doc_id"], docs["text"]) == terms["__h"], "left")
    out = out.withColumn("__spans", F.array_sort(F.concat(base_spans(F.col("text")), F.coalesce("__terms", F.array().cast(_SPAN)))))
    out = out.withColumn("text", F.when(F.size("__spans") > 0, _replaced(F.col("text"), F.col("__spans"), _sign)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
