"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows is scored by its log frequency in each language.  An
unseen word is scored by its character 4-grams; one of these that is unseen falls
back to its last three characters, then two, then one.  A text's score is the sum
over its words; the language with the largest one is predicted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import pick, write_table

UNKNOWN = "und"
#: Bounds of what is fitted: labelled texts used (in expectation, by a hash of doc_id),
#: known words and n-grams of each size for a language.  No language is left out.
SAMPLE_TEXTS, WORDS, GRAMS = 20_000, 30_000, 10_000
#: Numbers in the tables of all languages, 128 MB: with more than some 20 languages, each
#: has fewer words and n-grams.
VALUES = 1 << 25
SIZES = (4, 3, 2, 1)
#: Weight of a step to shorter n-grams, and of an unseen word against a known one.
BACKOFF = 0.4
#: Words whose scores a worker remembers.
CACHE_WORDS = 400_000
#: Words at most that a posterior counts as independent evidence.
EVIDENCE = 40

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L) in lower case; number signs such as one half are none."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + size] for i in range(max(1, len(padded) - size + 1))]


@dataclass
class Model:
    """Log probabilities, a row for each known word or n-gram and a column for each language."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    index: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    matrix: np.ndarray | None = None

    def word_score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        total = np.zeros(len(self.languages))
        pieces = grams_of(word, SIZES[0])
        for g in pieces:
            for step, size in enumerate(SIZES):
                found = self.grams.get(g[-size:])
                if found is not None:
                    total += BACKOFF**step * found
                    break
        return total / len(pieces)

    def _row(self, word: str) -> int:
        k = self.index[word] = len(self.rows)
        self.rows.append(self.word_score(word))
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior); ``und`` and 0 without a letter."""
        words = words_of(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self.rows) > CACHE_WORDS:
            self.index.clear()
            self.rows.clear()
            self.matrix = None
        at = [self.index.get(w) for w in words]
        if None in at:
            at = [self.index[w] if w in self.index else self._row(w) for w in words]
        have = 0 if self.matrix is None else self.filled
        if have < len(self.rows):
            if self.matrix is None or len(self.matrix) < len(self.rows):
                grown = np.zeros((2 * len(self.rows), len(self.languages)))
                if have:
                    grown[:have] = self.matrix[:have]
                self.matrix = grown
            self.matrix[have : len(self.rows)] = self.rows[have:]
            self.filled = len(self.rows)
        mean = self.matrix[at].mean(axis=0)
        best = int(np.argmax(mean))
        odds = np.exp((mean - mean[best]) * min(len(words), EVIDENCE))
        return self.languages[best], float(1.0 / odds.sum())


def _thinned(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``counts`` (lang, ..., n) without the rarest, so that each lang has ``most`` rows at most."""
    sizes: dict[tuple, list] = {}
    for r in counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("rows")).collect():  # counts of counts
        sizes.setdefault(tuple(r[k] for k in keys), []).append((r["n"], r["rows"]))
    keep = None
    for key, rows in sizes.items():
        least, total = None, 0
        for n, m in sorted(rows, reverse=True):
            total += m
            if total > most:
                break
            least = n
        if least is not None:
            here = F.col("n") >= least
            for k, v in zip(keys, key, strict=True):
                here &= F.col(k) == v
            keep = here if keep is None else keep | here
    return counts.where(keep if keep is not None else F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on texts with a language that are not held out: all of them, or about ``texts`` chosen by a hash of doc_id."""
    labelled = pick(docs, ["doc_id", "text", "lang"]).where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    langs = [(r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each language
    total = sum(n for _, n in langs)
    if not total:
        return Model([], {}, {})
    names = sorted(x for x, _ in langs)
    chosen = labelled
    if total > texts:
        chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * texts / total))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in found.items():
            yield pa.record_batch([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts = chosen.select("text", "lang").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = write_table(spark, counts, "lang-words")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for size in SIZES:
                    for g in grams_of(word, size):
                        found[lang, size, g] += n
            yield pa.record_batch([pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int32()), pa.array([k[2] for k in found]), pa.array(list(found.values()), pa.int64())], names=["lang", "size", "gram", "n"])

    grams = counts.mapInArrow(pieces, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    grams = write_table(spark, grams, "lang-grams")
    column = {x: i for i, x in enumerate(names)}

    def table(rows: DataFrame, key) -> dict[str, np.ndarray]:
        got = rows.toArrow()  # for each language the rows that _thinned left
        if not len(got):
            return {}
        keys, at = np.unique(np.array(got[1].to_pylist(), dtype=object), return_inverse=True)
        n = np.zeros((len(keys), len(names)), dtype=np.float32)
        n[at, [column[x] for x in got[0].to_pylist()]] = got[2].to_numpy()
        n += np.float32(0.5)
        sizes = np.array([len(x) for x in keys])
        for size in np.unique(sizes):
            n[sizes == size] /= key(int(size)).astype(np.float32)
        return dict(zip(keys.tolist(), np.log(n, out=n), strict=True))

    share = VALUES // len(names) ** 2
    most = min(WORDS, max(1, share // 2)), min(GRAMS, max(1, share // 8))
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    word_total = np.array([sums.get(x, 0) + 0.5 * WORDS for x in names])
    parts = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    gram_total = {s: np.array([parts.get((x, s), 0) + 0.5 * GRAMS for x in names]) for s in SIZES}
    known = table(_thinned(counts, ["lang"], most[0]).select("lang", "word", "n"), lambda size: word_total)
    seen = table(_thinned(grams, ["lang", "size"], most[1]).select("lang", "gram", "n"), lambda size: gram_total[size])
    return Model(names, known, seen)


def identify(spark: SparkSession, docs: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Only texts and languages of rows that are not held out are learned from; a
    prediction sees the text alone.  Null texts and texts without a letter are
    ``und`` with score 0; ties go to the first language by name; very long texts are
    read whole; a null lang is not learned from; repeated rows are predicted each; an
    empty table gives no rows; without any labelled row all are ``und``.
    """
    shared = spark.sparkContext.broadcast(fit(spark, docs, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for b in batches:
            found = list(map(predict, b.column(2).to_pylist()))
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, ["doc_id", "text"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
