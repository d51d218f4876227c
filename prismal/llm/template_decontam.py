"""Benchmark decontamination by templates, in DataFrame functions only.

Each word becomes itself in lower case or a typed placeholder: NUM (begins with a
digit), NAME (has a capital), UNIT (a unit of measure).  Windows of such words are
hashed and joined with those of the benchmark, so a question whose numbers and
names were changed still meets its original.  A window that is nearly all
placeholders is hashed by its words instead, so that its copies meet it and nothing
else does.  A meeting counts when enough windows lie on one alignment and every slot
of the original keeps one value there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, let, pick, write_table

#: Words in a window, and how many of them must be no placeholder; with fewer (of a
#: shorter window: with any) it is known by its words alone.
WINDOW, LITERALS = 8, 4
#: An item of fewer words is found only where it is all of a text.
SHORT = 5
#: Windows on one alignment: six are 13 words in a row; a shorter item must match whole.
MATCHES = 6

PUNCTUATION = ".,;:!?\"'()[]{}<>#*$%&|+=~^`_/\\-"

UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons pint pints cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v kv j kj kwh pa kpa n nm "
    "b kb mb gb tb bit bits byte bytes k c f degree degrees percent dollar dollars cent cents euro euros usd eur gbp"
).split()


def raw_words(text: Column) -> Column:
    """Words without ASCII punctuation; empty for null."""
    bare = F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, "")
    return F.filter(F.split(bare, "[ \\t-\\r]+"), lambda w: w != "")


def template(word: Column) -> Column:
    return F.when((word >= "0") & (word < ":"), "NUM").when(F.lower(word) != word, "NAME").when(word.isin(UNITS), "UNIT").otherwise(word)


def _is_literal(canon: Column) -> Column:
    return ~canon.isin("NUM", "NAME", "UNIT")


def _parts(raw: Column, worded: bool = True) -> Column:
    """What windows are made of: a hash of each word's template, one of the word, and 1 for a literal word.

    The last two are asked for only where some windows are known by their words.
    """

    def of(canon: Column) -> Column:
        kinds = F.transform(canon, lambda w: F.xxhash64(w)).alias("kinds")
        if not worded:
            return F.struct(kinds)
        return F.struct(kinds, F.transform(raw, lambda w: F.xxhash64(F.lit(2), F.lower(w))).alias("words"), F.transform(canon, lambda w: F.when(_is_literal(w), 1).otherwise(0)).alias("literal"))

    return let(F.transform(raw, template), of).alias("parts")


def _joined(items: Column, width: int, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of each ``width`` neighbours, in halves; those at the end are of fewer."""
    if width == 1:
        return items
    half = 1 << ((width - 1).bit_length() - 1)
    behind = lambda x: F.slice(x, F.lit(half + 1), F.size(x))
    if width == 2 * half:
        return let(_joined(items, half, join), lambda x: F.zip_with(x, behind(x), join))
    return let(items, lambda x: F.zip_with(_joined(x, half, join), behind(_joined(x, width - half, join)), join))


_NO_WINDOWS = "array<struct<at:int,width:int,hash:bigint>>"


def _hashes(width: int, worded: bool = True) -> Column:
    """The hash of each window from ``raw`` and its ``parts``."""
    mixed = lambda x, y: F.xxhash64(x, y)
    known = _joined(F.col("parts.kinds"), width, mixed)
    if worded:
        enough = F.zip_with(_joined(F.col("parts.literal"), width, lambda x, y: x + y), known, lambda n, h: F.when(n >= min(LITERALS, width), h))
        known = F.zip_with(enough, _joined(F.col("parts.words"), width, mixed), lambda x, y: F.coalesce(x, y))
    return F.slice(known, F.lit(1), F.greatest(F.size("raw") - (width - 1), F.lit(0)))


def _windows(width: int, worded: bool = True) -> Column:
    """array of struct(at, width, hash) from ``raw`` and its ``parts``, at from 1."""
    return F.transform(_hashes(width, worded), lambda h, i: F.struct((i + 1).alias("at"), F.lit(width).alias("width"), h.alias("hash"))).cast(_NO_WINDOWS)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, width, item_id, item_at, item_raw, item_canon, item_size, item_windows of each window.

    Items shorter than a window are one window of their own width.  Items of one
    template whose slots repeat alike are the least of them, if no window of theirs is
    known by its words.
    """
    items = pick(benchmark, ["item_id", "text"]).select("item_id", raw_words(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    items = items.withColumn("canon", F.transform("raw", template)).withColumn("width", F.least(F.size("raw"), F.lit(WINDOW)))
    literal = lambda i: F.size(F.filter(F.slice("canon", i, F.col("width")), _is_literal))
    worded = F.exists(F.sequence(F.lit(1), F.size("raw") - F.col("width") + 1), lambda i: literal(i) < F.least(F.lit(LITERALS), F.col("width")))
    pattern = F.transform("raw", lambda w: F.when(_is_literal(template(w)), 0).otherwise(F.array_position("raw", w)).cast("int"))
    same = F.when(worded, F.transform("raw", lambda w: F.lower(w)))
    items = items.groupBy("canon", "width", pattern.alias("pattern"), same.alias("same")).agg(F.min_by("raw", "item_id").alias("raw"), F.min("item_id").alias("item_id"))
    items = items.select("item_id", "raw", "canon", "width", _parts(F.col("raw"))).select("item_id", "raw", "canon", F.explode(F.coalesce(*[F.when(F.col("width") == w, _windows(w)) for w in range(1, WINDOW + 1)])).alias("w"))
    rows = items.select(
        F.col("w.hash").alias("hash"), F.col("w.width").alias("width"), "item_id", F.col("w.at").alias("item_at"), F.slice("raw", F.col("w.at"), F.col("w.width")).alias("item_raw"),
        F.slice("canon", F.col("w.at"), F.col("w.width")).alias("item_canon"), F.size("raw").alias("item_size"), (F.size("raw") - F.col("w.width") + 1).cast("long").alias("item_windows"),
    )
    return rows


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, shift, n_windows, item_windows of each alignment that counts."""
    bench = write_table(spark, benchmark_windows(benchmark), "benchmark-windows")
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())  # WINDOW values at most
    if not widths:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, shift int, n_windows long, item_windows long")
    side = broadcast_if_small(bench)
    words = pick(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("text_hash"), raw_words(F.col("text")).alias("raw"))
    # No text needs what no item has.
    worded = not bench.where(F.size(F.filter("item_canon", _is_literal)) < F.least(F.lit(LITERALS), F.col("width"))).isEmpty()
    words = words.select("doc_id", "text_hash", "raw", _parts(F.col("raw"), worded))  # the words end here: no window carries its text
    # A width below SHORT is asked of texts of that size only.  Windows are plain hashes until they are rows.
    asked = [F.struct(F.lit(w).alias("doc_width"), (_hashes(w, worded) if w >= SHORT else F.when(F.size("raw") == w, _hashes(w, worded))).alias("hashes")) for w in widths]
    rows = words.select("doc_id", "text_hash", F.explode(F.array(*asked)).alias("w")).select("doc_id", "text_hash", "w.doc_width", F.posexplode("w.hashes").alias("pos", "doc_hash"))
    met = rows.join(side, (F.col("doc_hash") == side["hash"]) & (F.col("doc_width") == side["width"]))
    at = F.col("pos") + 1
    found = met.select("doc_id", "text_hash", "item_id", "item_at", at.alias("doc_at"), (at - F.col("item_at")).alias("shift"), "item_windows", "item_raw", "item_canon")
    found = write_table(spark, found, "template-hits")
    by = ["doc_id", "text_hash", "item_id", "shift"]
    same = lambda x, y, on: [x[c].eqNullSafe(y[c]) for c in on]
    enough = found.groupBy(*by).agg(F.count_distinct("item_at").alias("n_windows"), F.first("item_windows").alias("item_windows")).where((F.col("n_windows") >= MATCHES) | (F.col("n_windows") >= F.col("item_windows")))
    enough = write_table(spark, enough, "alignments")
    # The words in the slots of these alignments, from their texts alone.
    hits = broadcast_if_small(enough.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    texts = pick(docs, ["doc_id", "text"]).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(hits, texts["doc_id"].eqNullSafe(hits["d"]) & (texts["text_hash"] == hits["h"])).dropDuplicates(["d", "h"])
    now = texts.select("doc_id", "text_hash", F.posexplode(raw_words(F.col("text"))).alias("pos", "now"))
    place = F.explode(F.transform("item_raw", lambda w, j: F.struct((F.col("doc_at") + j - 1).alias("pos"), F.element_at("item_canon", j + 1).alias("kind"), w.alias("was"))))
    slots = found.join(broadcast_if_small(enough.select(*by)), same(found, enough, by), "left_semi").select(*by, place.alias("s")).where(~_is_literal(F.col("s.kind"))).select(*by, "s.*").distinct()
    slots = slots.join(now, same(slots, now, ["doc_id", "text_hash", "pos"])).select(*[slots[c] for c in (*by, "kind", "was")], "now")
    # One original value, two values in the text: the slot is inconsistent there.
    value = slots.groupBy(*by, "kind", "was").agg((F.min("now") != F.max("now")).alias("torn"))
    torn = value.groupBy(*by).agg(F.count(F.lit(1)).alias("slots"), F.sum(F.col("torn").cast("long")).alias("torn"))
    kept = enough.join(torn, same(enough, torn, by), "left").where("torn is null or 2 * torn <= slots and torn <= 1")
    return kept.select(*[enough[c] for c in by], "n_windows", "item_windows")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, contaminated, n_windows, item_ids for each row of ``docs`` (doc_id, text).

    A text is contaminated when an alignment with an item has at least six matching
    windows of eight words (all, if the item has fewer; an item of fewer than five
    words must be the whole text) and its slots are consistent:
    no slot value of the item stands for two values in the text, one at most excepted
    where names begin sentences.  Windows of fewer than four literal words match word
    by word, without regard to case; so copies of items that are mostly numbers or
    names are found, and their re-parameterised forms are not.  A text all in capitals
    has no literal words.  ``item_ids`` is sorted, null where clean; items that differ
    in slot values only are reported as the least of them.  Null, empty and
    shorter texts are clean; null items and items without words match nothing; rows
    of one doc_id and text are judged together and each returned; an empty table
    gives no rows; other columns are not read.

    Texts are read once and not shuffled while the benchmark's windows are small
    enough to broadcast, which is checked; else the windows are joined by hash.
    """
    found = matches(spark, docs, benchmark)
    flagged = found.groupBy("doc_id", "text_hash").agg(F.sum("n_windows").alias("n_windows"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    flagged = broadcast_if_small(write_table(spark, flagged, "contaminated").withColumnsRenamed({"doc_id": "d", "text_hash": "h"}))
    rows = pick(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("text_hash"))
    out = rows.join(flagged, rows["doc_id"].eqNullSafe(flagged["d"]) & (rows["text_hash"] == flagged["h"]), "left")
    return out.select("doc_id", "text_hash", F.col("h").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "item_ids")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without contaminated rows.

    Null, empty and short texts stay, as do all texts if the benchmark is empty; rows
    of one doc_id and text go or stay together; very long texts are searched whole; an
    empty table gives no rows; other columns may have any name but ``__d`` and ``__h``.
    """
    found = matches(spark, docs, benchmark).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    flagged = broadcast_if_small(write_table(spark, found, "contaminated"))
    return docs.join(flagged, docs["doc_id"].eqNullSafe(flagged["__d"]) & (F.xxhash64(docs["text"]) == flagged["__h"]), "left_anti")


def contamination_sql() -> str:
    """DuckDB SQL for doc_id, contaminated, n_windows, item_ids (comma-joined) on documents and benchmark."""
    quoted = "'" + PUNCTUATION.replace("'", "''") + "'"
    units = ", ".join(f"'{u}'" for u in UNITS)
    raw = f"list_filter(string_split_regex(translate(coalesce(text, ''), {quoted}, ''), '[ \\t-\\r]+'), lambda w: w <> '')"
    canon = f"list_transform(raw, lambda w: CASE WHEN w >= '0' AND w < ':' THEN 'NUM' WHEN lower(w) <> w THEN 'NAME' WHEN w IN ({units}) THEN 'UNIT' ELSE w END)"
    slot = "('NUM', 'NAME', 'UNIT')"
    return f"""WITH i0 AS (SELECT item_id, {raw} AS raw FROM benchmark), i1 AS (SELECT item_id, raw, {canon} AS canon FROM i0 WHERE len(raw) > 0),
iw AS (SELECT item_id, raw, canon, least(len(raw), {WINDOW}) AS width, list_transform(raw, lambda w: lower(w)) AS low FROM i1),
ix AS (SELECT *, len(list_filter(range(1, len(raw) - width + 2), lambda i: len(list_filter(canon[i : i + width - 1], lambda w: w NOT IN {slot})) < least({LITERALS}, width))) > 0 AS worded,
  list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN canon[i] IN {slot} THEN list_position(raw, raw[i]) ELSE 0 END) AS pattern FROM iw),
i2 AS (SELECT canon, width, arg_min(raw, item_id) AS raw, min(item_id) AS item_id FROM ix GROUP BY canon, width, pattern, CASE WHEN worded THEN low END),
i3 AS (SELECT item_id, raw, list_transform(raw, lambda w: lower(w)) AS low, canon, width, unnest(range(1, len(raw) - width + 2)) AS item_at FROM i2),
i5 AS (SELECT item_id, width, item_at, raw[item_at : item_at + width - 1] AS item_raw, canon[item_at : item_at + width - 1] AS item_canon,
  CASE WHEN len(list_filter(canon[item_at : item_at + width - 1], lambda w: w NOT IN {slot})) >= least({LITERALS}, width) THEN 't' || array_to_string(canon[item_at : item_at + width - 1], chr(1)) ELSE 'v' || array_to_string(low[item_at : item_at + width - 1], chr(1)) END AS k FROM i3),
i6 AS (SELECT item_id, count(*) AS item_windows FROM i5 GROUP BY item_id),
d0 AS (SELECT doc_id, md5(coalesce(text, '')) AS h, {raw} AS raw FROM documents), d1 AS (SELECT doc_id, h, raw, list_transform(raw, lambda w: lower(w)) AS low, {canon} AS canon FROM d0),
d2 AS (SELECT doc_id, h, raw, low, canon, width, unnest(range(1, greatest(len(raw) - width + 2, 1))) AS doc_at FROM d1, (SELECT DISTINCT width FROM i5) AS w WHERE width >= {SHORT} OR len(raw) = width),
d3 AS (SELECT doc_id, h, width, doc_at, raw[doc_at : doc_at + width - 1] AS doc_raw,
  CASE WHEN len(list_filter(canon[doc_at : doc_at + width - 1], lambda w: w NOT IN {slot})) >= least({LITERALS}, width) THEN 't' || array_to_string(canon[doc_at : doc_at + width - 1], chr(1)) ELSE 'v' || array_to_string(low[doc_at : doc_at + width - 1], chr(1)) END AS k FROM d2),
m AS (SELECT d3.doc_id, h, i5.item_id, doc_at - item_at AS shift, item_at, item_raw, item_canon, doc_raw FROM d3 JOIN i5 ON d3.width = i5.width AND d3.k = i5.k),
e0 AS (SELECT doc_id, h, item_id, shift, count(DISTINCT item_at) AS n_windows FROM m GROUP BY doc_id, h, item_id, shift),
e AS (SELECT e0.doc_id, h, e0.item_id, shift, n_windows FROM e0 JOIN i6 ON e0.item_id = i6.item_id WHERE n_windows >= {MATCHES} OR n_windows >= item_windows),
s0 AS (SELECT doc_id, h, item_id, shift, unnest(item_canon) AS kind, unnest(item_raw) AS was, unnest(doc_raw) AS now FROM m),
s1 AS (SELECT doc_id, h, item_id, shift, kind, was, CASE WHEN min(now) <> max(now) THEN 1 ELSE 0 END AS torn FROM s0 WHERE kind IN {slot} GROUP BY doc_id, h, item_id, shift, kind, was),
s AS (SELECT doc_id, h, item_id, shift, count(*) AS slots, sum(torn) AS torn FROM s1 GROUP BY doc_id, h, item_id, shift),
g AS (SELECT e.doc_id, e.h, e.item_id, n_windows FROM e LEFT JOIN s ON e.doc_id = s.doc_id AND e.h = s.h AND e.item_id = s.item_id AND e.shift = s.shift WHERE torn IS NULL OR (2 * torn <= slots AND torn <= 1)),
f AS (SELECT doc_id, h, CAST(sum(n_windows) AS BIGINT) AS n_windows, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids FROM g GROUP BY doc_id, h)
SELECT d0.doc_id, f.h IS NOT NULL AS contaminated, coalesce(n_windows, 0) AS n_windows, coalesce(item_ids, '') AS item_ids FROM d0 LEFT JOIN f ON d0.doc_id = f.doc_id AND d0.h = f.h"""
