"""N-gram Jaccard join by grouped prefixes.

A text is the set of its five-word shingles, held in one global order: shingles of
crowded sketch slots last, the rest by hash.  Two sets of Jaccard similarity t share
a shingle of their prefixes (the first n - ceil(t n) + 1), so only texts that meet
there are compared.  Texts of the same size and prefix are one group; groups are
paired, then expanded to their distinct sets, and these are verified exactly.

No run of equal shingles is ever paired with itself when it is crowded.  Its sets meet
a few leaders, and links to these join most of them into components.  Where a run
still holds several components, its sets are rewritten as what sets them apart from
one leader: two sets x and y can only be similar, and not both be similar to the
leader, if they share some of that (the symmetric difference is a metric), so runs of
equal differences are searched next, and crowded ones of these get a leader of their
own, until none is left.  Small runs are verified where they lie: only links leave
a task, a forest of them for each run.  No link between components is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .graph import SMALL_EDGES, components
from .shared import broadcast_if_small, pick, write_table
from .textkit import chunks, mix, windows

WORDS = 5
#: Similarity as a fraction: 75 of 100.
SHARE, WHOLE = 75, 100
#: Slots of the sketch that tells crowded shingles; 32 MB in a worker.
SLOT_BITS = 24
#: A task reports slots that have so many texts and deviations more than the mean.
CROWD, DEVIATIONS = 1, 4
#: Of so many texts (by their hash) one tells its shingles to the sketch beyond that, so
#: that one in every task is found too; this only orders shingles.
TELLING = 64
#: Slots of so many texts (a power of two) are crowded for sure: no task looks for their run.
HOT, SALTS = 8, 64
#: Up to so many sets of a shingle are paired at once; more begin with leaders, so many.
PAIRED = 8
LEADERS = 4
#: Runs of more sets, or more bytes of differences, are not held in a task.
DIRECT, DIRECT_BYTES = 1024, 1 << 25
#: Bits of the filters that tell which sets verification needs and which prefixes occur again.
FILTER_BITS = 1 << 26

Sets = Iterator[tuple[int, np.ndarray]]


def shingle_sets(texts: list[str | None]) -> Sets:
    """(row, sorted distinct shingle hashes) for each text that has a word; A-Z as a-z."""
    for c in chunks(texts, lower=True):
        shingles = windows(c.hashes, WORDS)
        for i, (a, b) in enumerate(zip(c.first[:-1].tolist(), c.first[1:].tolist(), strict=True)):
            if b - a >= WORDS:
                yield c.lo + i, np.unique(shingles[a : b - WORDS + 1])
            elif b > a:
                yield c.lo + i, mix(windows(c.hashes[a:b], b - a) + np.uint64(b - a))


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def crowded_slots(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(slots, class) of slots that hold many shingles; any outcome orders right, a good one pairs less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        count, total = np.zeros(1 << SLOT_BITS, dtype=np.uint16), 0  # stops at 65,535
        told: list[np.ndarray] = []
        for b in batches:
            for _, s in shingle_sets(b.column(0).to_pylist()):
                slots, n = np.unique(slot_of(s), return_counts=True)
                count[slots] = np.minimum(count[slots].astype(np.int64) + n, 65_535)
                total += len(s)
                if int(mix(s).sum()) % TELLING == 0:
                    told.append(slots.astype(np.int32))
        mean = total / (1 << SLOT_BITS)
        many = count > mean + DEVIATIONS * mean**0.5 + CROWD
        slots = np.flatnonzero(many)
        rest, n = np.unique(np.concatenate([np.empty(0, np.int32), *told]), return_counts=True)
        n = n[~many[rest]]
        rest = rest[~many[rest]]
        kind = np.repeat(np.array([0, 1], np.int32), [len(slots), len(rest)])
        yield pa.record_batch([pa.array(np.append(slots, rest), pa.int32()), pa.array(kind), pa.array(np.append(count[slots].astype(np.int64), n))], names=["slot", "kind", "n"])
        del count, many, told
        bpe.trim()

    told = pick(docs, ["text"]).mapInArrow(run, "slot int, kind int, n long")
    sure, hint = F.coalesce(F.sum(F.expr("if(kind = 0, n, null)")), F.lit(0)), F.coalesce(F.sum(F.expr("if(kind = 1, n, null)")), F.lit(0))
    # A slot that no task found crowded must be told several times, by texts that stand for TELLING.
    found = told.groupBy("slot").agg(sure.alias("sure"), hint.alias("hint")).where("sure > 0 or hint > 2")
    got = found.select("slot", (F.col("sure") + TELLING * F.col("hint")).alias("n")).toArrow()  # 2 ** SLOT_BITS rows at most
    slots, n = got["slot"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(slots)
    return slots[order].astype(np.int64), np.frexp(n[order].astype(np.float64))[1].astype(np.uint64)


def prefix_length(n: int) -> int:
    """Shingles that a set of ``n`` must offer to meet every similar one."""
    return n - -(-SHARE * n // WHOLE) + 1


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def histogram(hashes: np.ndarray) -> bytes:
    """How many of a set lie in each of 2 ** k equal ranges, two to a range about; counts stop at 255."""
    k = max(3, (len(hashes) - 1).bit_length() - 1)
    return np.minimum(np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def most_common(x: bytes, y: bytes, n: int, m: int) -> int:
    """An upper bound of what sets of sizes ``n`` and ``m`` with these histograms share."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.max() == 255 or b.max() == 255:
        return min(n, m)
    a, b = a.astype(np.int64), b.astype(np.int64)
    if len(a) > len(b):
        a, b = b, a
    b = b.reshape(len(a), -1).sum(axis=1)
    return int(np.minimum(a, b).sum())


_ROWS = "doc_id long, n long, signature long, grp long, prefix binary, histogram binary"


def _describe(crowd) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _ROWS for the texts of a batch; n is 0 without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        slots, classes = crowd.value
        rank = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
        rank[slots] = classes
        for b in batches:
            m = b.num_rows
            n, sign, grp = (np.zeros(m, dtype=np.int64) for _ in range(3))
            prefix: list[bytes | None] = [None] * m
            hist: list[bytes | None] = [None] * m
            for i, s in shingle_sets(b.column(1).to_pylist()):
                r = rank[slot_of(s)]
                if r.any():
                    first = s[np.argsort(r, kind="stable")[: prefix_length(len(s))]]
                else:
                    first = s[: prefix_length(len(s))]
                at = np.arange(1, len(first) + 1, dtype=np.uint64)
                n[i] = len(s)
                sign[i] = int(mix(s * np.uint64(0xD6E8FEB86659FD93)).sum().view(np.int64))
                grp[i] = int(np.append(mix(first ^ mix(at)), mix(np.array([len(s)], dtype=np.uint64))).sum().view(np.int64))
                prefix[i] = first.tobytes()
                hist[i] = histogram(s)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(n), pa.array(sign), pa.array(grp), pa.array(prefix, pa.binary()), pa.array(hist, pa.binary())], names=[c.split(" ")[0] for c in _ROWS.split(", ")])
        del rank
        bpe.trim()

    return run


_POSTINGS = "token long, grp long, sets int, place long, salt int"


def _postings(crowd) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_POSTINGS for each shingle of a prefix of (grp, n, sets, prefix); place is n * 2 ** 32 + position.

    The salt deals a hot shingle out to many partitions; it is -1 for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, classes = crowd.value
        hot = slots[classes > HOT]
        for b in batches:
            raw = b.column(3).to_pylist()
            size = np.fromiter((len(r) // 8 for r in raw), np.int64, len(raw))
            token = np.frombuffer(b"".join(raw), np.uint64)
            at = np.cumsum(size) - size
            place = np.repeat(b.column(1).to_numpy() << 32, size) + np.arange(len(token)) - np.repeat(at, size)
            grp = np.repeat(b.column(0).to_numpy(), size)
            yield pa.record_batch(
                [pa.array(_signed(token)), pa.array(grp), pa.array(np.repeat(b.column(2).to_numpy(), size), pa.int32()), pa.array(place), pa.array(np.where(_within(slot_of(token), hot), grp % SALTS, -1), pa.int32())],
                names=[c.split(" ")[0] for c in _POSTINGS.split(", ")],
            )

    return run


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), dtype=bool)


def _may_match(n1, p1, n2, p2):
    """Can sets of sizes n1 <= n2 whose first common shingle is at p1 and p2 be similar?"""
    need = -(-SHARE * (n1 + n2) // (SHARE + WHOLE))
    return (WHOLE * n1 >= SHARE * n2) & (p1 <= n1 - need) & (p2 <= n2 - need)


def _apart(n, m):
    """How much sets of sizes n and m can differ and be similar."""
    return (WHOLE - SHARE) * (n + m) // (WHOLE + SHARE)


def _reach(n, pos):
    """v: sets that first share what is at ``pos`` can be similar only if their v add up to 0 at most."""
    return (WHOLE + SHARE) * pos - (WHOLE - SHARE) * n


def _runs_of(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the runs in a sorted array."""
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(token)))


_PAIRS = "kind int, a long, b long, token long, place long"


def _pair_rows(kind: int, a: np.ndarray, b: np.ndarray, token: np.ndarray | None = None, place: np.ndarray | None = None) -> pa.RecordBatch:
    zero = np.zeros(len(a), dtype=np.int64)
    return pa.record_batch([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(zero if token is None else token), pa.array(zero if place is None else place)], names=[c.split(" ")[0] for c in _PAIRS.split(", ")])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return a[new], b[new]


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From _POSTINGS by token: pairs of groups (kind 0) of small runs, the postings of others (kind 1), and of hot or large ones (kind 2).

    A run is paired where it lies if few of its pairs can be similar by where they meet.
    At most DIRECT rows of a run are held: what follows in a larger one is passed on.
    """

    def pairs(token, grp, sets, place) -> Iterator[pa.RecordBatch]:
        n, pos = place >> 32, place & 0xFFFFFFFF
        begin, size = _runs_of(token)
        if not len(begin):
            return
        few = np.repeat((np.add.reduceat(sets, begin) <= PAIRED) | (size == 1), size)
        left, right = [], []
        for k in range(1, PAIRED):
            i = np.flatnonzero((token[k:] == token[:-k]) & few[k:]) if len(token) > k else np.empty(0, np.int64)
            if not len(i):
                break
            ok = _may_match(n[i], pos[i], n[i + k], pos[i + k])
            left.append(i[ok])
            right.append(i[ok] + k)
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            yield _pair_rows(0, *_distinct(np.minimum(grp[i], grp[j]), np.maximum(grp[i], grp[j])))
        if not few.all():
            yield from larger(*(c[~few] for c in (token, grp, sets, place)))

    def larger(token, grp, sets, place) -> Iterator[pa.RecordBatch]:
        n, pos = place >> 32, place & 0xFFFFFFFF
        v = _reach(n, pos)
        begin, size = _runs_of(token)
        able = v <= -np.repeat(np.minimum.reduceat(v, begin), size)
        token, grp, sets, place, n, pos, v = (c[able] for c in (token, grp, sets, place, n, pos, v))
        begin, size = _runs_of(token)
        left, right, crowded = [], [], []
        for s, m in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            e = s + m
            low = np.sort(v[s:e])
            if m <= DIRECT and (np.searchsorted(low, -low, "right").sum() - (low <= 0).sum()) // 2 <= 4 * PAIRED * m:
                i, j = (k + s for k in np.nonzero(np.triu(v[s:e, None] + v[s:e] <= 0, 1)))
                ok = _may_match(n[i], pos[i], n[j], pos[j])
                i, j = i[ok], j[ok]
                if (sets[i].astype(np.int64) * sets[j]).sum() <= PAIRED * sets[s:e].sum():
                    left.append(np.minimum(grp[i], grp[j]))
                    right.append(np.maximum(grp[i], grp[j]))
                    continue
            crowded.append(np.arange(s, e))
        if left:
            yield _pair_rows(0, *_distinct(np.concatenate(left), np.concatenate(right)))
        if crowded:
            on = np.concatenate(crowded)
            yield _pair_rows(1, grp[on], grp[on], token[on], place[on])

    carry, open_run = None, None
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(5)]
        hot = cols.pop() >= 0
        if hot.any():
            yield _pair_rows(2, cols[1][hot], cols[1][hot], cols[0][hot], cols[3][hot])
            cols = [c[~hot] for c in cols]
        if open_run is not None:
            k = int(np.searchsorted(cols[0], open_run, "right"))
            if k:
                yield _pair_rows(2, cols[1][:k], cols[1][:k], cols[0][:k], cols[3][:k])
            cols = [c[k:] for c in cols]
        if not len(cols[0]):
            continue
        open_run = None
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        yield from pairs(*(c[:cut] for c in cols))
        carry = [c[cut:] for c in cols]
        if len(carry[0]) > DIRECT:
            yield _pair_rows(2, carry[1], carry[1], carry[0], carry[3])
            open_run, carry = carry[0][0], None
    if carry is not None:
        yield from pairs(*carry)


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (token, x, place, histogram) by token: pairs of sets that can be similar (kind 0), or the sets of runs with many (kind 1).

    Texts that share a common phrase by chance make crowded runs too, more of them the
    larger the corpus.  Histograms tell that hardly any of these can be similar, so a set
    stays in a run only with another one there that it can be similar to.  Runs of
    more than 4 * DIRECT sets stay whole.
    """

    def screened(token: int, x: np.ndarray, place: np.ndarray, hist: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(place >> 32, kind="stable")
        x, place = x[order], place[order]
        n, pos = place >> 32, place & 0xFFFFFFFF
        able = _by_histograms(n, pos, [hist[k] for k in order.tolist()])
        m = len(x)
        kept = np.zeros(m, dtype=bool)
        for k in range(1, min(PAIRED, m - 1) + 1):
            i = np.arange(m - k)
            ok = able(i, i + k)
            kept[:-k] |= ok
            kept[k:] |= ok
        for i, j in _blocks(np.flatnonzero(~kept), np.arange(m)):
            ok = able(np.minimum(i, j), np.maximum(i, j))
            kept[i[ok]] = kept[j[ok]] = True
        on = np.flatnonzero(kept)
        left, right, total = [], [], 0
        for i, j in _blocks(on, on):
            i, j = i[i < j], j[i < j]
            ok = able(i, j)
            total += int(ok.sum())
            if total > PAIRED * len(on):
                yield _pair_rows(1, x[on], x[on], np.full(len(on), token), place[on])
                return
            left.append(x[i[ok]])
            right.append(x[j[ok]])
        if total:
            a, b = np.concatenate(left), np.concatenate(right)
            yield _pair_rows(0, *_distinct(np.minimum(a, b), np.maximum(a, b)))

    token, held, large = None, [], False
    for b in batches:
        tokens = b.column(0).to_numpy()
        for s, m in zip(*(y.tolist() for y in _runs_of(tokens)), strict=True):
            if token is not None and tokens[s] != token:
                if held:
                    yield from screened(token, *(np.concatenate([h[k] for h in held]) for k in (0, 1)), [y for h in held for y in h[2]])
                held, large = [], False
            token = int(tokens[s])
            held.append((b.column(1).to_numpy()[s : s + m], b.column(2).to_numpy()[s : s + m], b.column(3).slice(s, m).to_pylist()))
            if large or sum(len(h[0]) for h in held) > 4 * DIRECT:
                for x, place, _ in held:
                    yield _pair_rows(1, x, x, np.full(len(x), token), place)
                held, large = [], True
    if held:
        yield from screened(token, *(np.concatenate([h[k] for h in held]) for k in (0, 1)), [y for h in held for y in h[2]])


def _blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``a`` with each other one of ``b``, some at a time."""
    step = max(1, (1 << 16) // max(1, len(b)))
    for lo in range(0, len(a), step):
        i, j = np.repeat(a[lo : lo + step], len(b)), np.tile(b, len(a[lo : lo + step]))
        yield i[i != j], j[i != j]


def _by_histograms(n: np.ndarray, pos: np.ndarray, hist: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells which pairs i < j of sets, sorted by size ``n``, can be similar by ``pos`` and their histograms (``most_common``)."""
    level = np.array([len(h).bit_length() - 1 for h in hist])
    own, first = {}, {}
    for k in np.unique(level).tolist():
        first[k] = int(np.searchsorted(level, k))
        own[k] = np.frombuffer(b"".join(h for h in hist if len(h) == 1 << k), np.uint8).reshape(-1, 1 << k)
    full = np.concatenate([own[k].max(axis=1) == 255 for k in own])
    half = {k - 1: own[k].astype(np.uint16).reshape(len(own[k]), -1, 2).sum(axis=2, dtype=np.uint16) for k in own}

    def able(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = _may_match(n[i], pos[i], n[j], pos[j])
        ask = np.flatnonzero(ok)
        common = n[i].copy()
        for k in own:
            for other, more in ((own, 0), (half, 1)):
                on = ask[(level[i[ask]] == k) & (level[j[ask]] == k + more) & ~full[i[ask]] & ~full[j[ask]]]
                step = max(1, (1 << 23) >> k)
                for lo in range(0, len(on), step):
                    at = on[lo : lo + step]
                    common[at] = np.minimum(own[k][i[at] - first[k]], other[k][j[at] - first[k + more]]).sum(axis=1, dtype=np.int64)
        return ok & (WHOLE * common >= SHARE * (n[i] + n[j] - common))

    return able


def _filter_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _bits_of(ids: DataFrame) -> np.ndarray:
    """A bit for each id in the columns of ``ids``, in a filter of fixed size; other ids may pass it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b in batches:
            for i in range(b.num_columns):
                at = _filter_of(b.column(i).to_numpy())
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at])], names=["at", "word"])

    got = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words[got["at"].to_numpy()] = got["word"].to_numpy()
    return words.view(np.uint8)


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _filter_of(ids)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _groups(spark: SparkSession, known: DataFrame, several: DataFrame) -> DataFrame:
    """(head, n, sets, prefix) of each group in ``known`` (doc_id, n, grp, prefix), by the doc_id of its least member.

    Most groups are one text, whose prefix need not be shuffled to find that out: a filter
    of the groups with several rows tells so, and what it lets pass besides is only grouped
    for nothing.
    """
    often = known.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("grp")
    again = spark.sparkContext.broadcast(_bits_of(often))

    def rows(repeats: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(_passes(again.value, b.column(2).to_numpy()) == repeats))

        return known.select("doc_id", "n", "grp", "prefix").mapInArrow(run, "doc_id long, n long, grp long, prefix binary")

    grouped = rows(True).groupBy("grp", "n").agg(F.min("doc_id").alias("head"), F.first("prefix").alias("prefix"))
    grouped = grouped.join(broadcast_if_small(several.select("grp", "sets")), "grp", "left").select("head", "n", F.coalesce("sets", F.lit(1)).alias("sets"), "prefix")
    return rows(False).select(F.col("doc_id").alias("head"), "n", F.lit(1).alias("sets"), "prefix").union(grouped)


def _sets_of(spark: SparkSession, docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(id, shingles) of the texts whose doc_id is in the two columns of ``ids``; only these sets are made."""
    needed = spark.sparkContext.broadcast(_bits_of(ids.select("a", "b")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = needed.value
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            b = b.filter(pa.array(_passes(bits, b.column(0).to_numpy())))
            ids = b.column(0).to_pylist()
            found = [(ids[i], s.tobytes()) for i, s in shingle_sets(b.column(1).to_pylist())]
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["id", "shingles"])
        bpe.trim()

    made = pick(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(sets, "id long, shingles binary")
    return write_table(spark, made, name)


def _possible(spark: SparkSession, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The (a, b) of ``pairs`` that can be similar by the histograms in ``sets`` (rep, n, histogram)."""

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n, m = (b.column(i).to_pylist() for i in range(2, 6))
            ok = []
            for u, v, p, q in zip(x, y, n, m, strict=True):
                common = most_common(u, v, p, q)
                ok.append(WHOLE * common >= SHARE * (p + q - common))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("n"), F.col("histogram").alias("x")), "a")
    both = one.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("histogram").alias("y")), "b")
    return write_table(spark, both.select("a", "b", "x", "y", "n", "m").mapInArrow(able, "a long, b long"), name)


def _similar(spark: SparkSession, pairs: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets in ``made`` (id, shingles) are similar."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(WHOLE * common >= SHARE * (len(both) - common))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(made.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
    both = one.join(made.withColumnsRenamed({"id": "a", "shingles": "x"}), "a").select("a", "b", "x", "y")
    return write_table(spark, both.mapInArrow(similar, "a long, b long"), name)


def _verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar. Histograms decide whose sets are made and moved."""
    able = _possible(spark, pairs, sets, f"{name}-possible")
    return _similar(spark, able, _sets_of(spark, docs, able, f"{name}-sets"), f"{name}-links")


_MEMBERS = [f"l{k}" for k in range(LEADERS)]


def _with_leaders(crowded: DataFrame) -> DataFrame:
    """l0, l1, ..., x, mask: the sets (token, x, place) of crowded runs with the leaders of their run.

    Leaders are of one range of sizes and meet the next one too; a set is in the runs
    of two ranges.  They are the least by seeded hashes, so that runs of the same sets
    have the same ones.  Bit k of ``mask`` tells that leader k can be similar to x.
    """
    n, pos = F.shiftright("place", 32), F.col("place").bitwiseAND(0xFFFFFFFF)
    band = F.floor(F.log(n) / F.log(F.lit(WHOLE / SHARE)))
    rows = crowded.select("token", "x", "place", band.alias("band")).withColumn("zone", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    key = [F.xxhash64("x", F.lit(k)) for k in range(LEADERS)]
    first = [c for k in range(LEADERS) for c in (F.min_by("x", key[k]).alias(f"l{k}"), F.min_by("place", key[k]).alias(f"p{k}"))]
    leaders = rows.where("band = zone").groupBy("token", "zone").agg(*first)
    mask = F.lit(0)
    for k in range(LEADERS):
        m, at = F.shiftright(f"p{k}", 32), F.col(f"p{k}").bitwiseAND(0xFFFFFFFF)
        need = F.ceil(F.lit(SHARE) * (n + m) / (SHARE + WHOLE))
        able = (WHOLE * F.least(n, m) >= SHARE * F.greatest(n, m)) & (pos <= n - need) & (at <= m - need) & (F.col("x") != F.col(f"l{k}"))
        mask = mask.bitwiseOR(F.when(able, 1 << k).otherwise(0))
    return rows.join(leaders, ["token", "zone"]).select(*_MEMBERS, "x", mask.alias("mask")).groupBy(*_MEMBERS, "x").agg(F.bit_or("mask").alias("mask"))


def _star_pairs(stars: DataFrame) -> DataFrame:
    met = stars.select("x", F.explode(F.array(*[F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col(f"l{k}")) for k in range(LEADERS)])).alias("l")).where("l is not null")
    return met.select(F.least("x", "l").alias("a"), F.greatest("x", "l").alias("b"))


def _labelled(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """``df`` with the component of x."""
    return df.join(nodes.withColumnsRenamed({"node": "x", "component": "c"}), "x", "left").withColumn("c", F.coalesce("c", "x"))


def _still_open(df: DataFrame, by: list[str]) -> DataFrame:
    """The values of ``by`` whose sets are in several components."""
    return df.groupBy(*by).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select(*by)


_DIFFERENCES = "bundle long, leader long, x long, n long, near boolean, d binary"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_DIFFERENCES from (leader, x, their shingles): what is in one of both only."""
    for b in batches:
        rows = []
        for u, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            own, lead = np.frombuffer(v, np.uint64), np.frombuffer(u, np.uint64)
            both = np.sort(np.concatenate([own, lead]))
            twice = both[1:] == both[:-1]
            d = both[~(np.append(twice, False) | np.append(False, twice))]
            rows.append((int(mix(lead).sum().view(np.int64)), len(own), len(d) <= _apart(len(own), len(lead)), d.tobytes()))
        bundle, n, near, d = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([pa.array(bundle, pa.int64()), b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(near, pa.bool_()), pa.array(d, pa.binary())], names=[c.split(" ")[0] for c in _DIFFERENCES.split(", ")])


def _tokens(bundle: int, d: np.ndarray) -> np.ndarray:
    return mix(d ^ mix(np.array([bundle], dtype=np.int64).view(np.uint64)))


def _frequent(apart: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(slots, class) of the differences (bundle, d) that several sets have; it only orders them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SLOT_BITS, dtype=np.uint16)
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                slots = np.unique(slot_of(_tokens(k, np.frombuffer(d, np.uint64))))
                count[slots] = np.minimum(count[slots].astype(np.int64) + 1, 65_535)
        slots = np.flatnonzero(count)
        yield pa.record_batch([pa.array(slots, pa.int32()), pa.array(count[slots], pa.int64())], names=["slot", "n"])

    got = apart.select("bundle", "d").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 3").toArrow()  # 2 ** SLOT_BITS rows at most
    slots, n = got["slot"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(slots)
    return slots[order].astype(np.int64), np.frexp(n[order].astype(np.float64))[1].astype(np.uint8)


_OFFERS = "token long, v long, bundle long, x long, c long, size long"


def _offers(crowd) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_OFFERS for the first differences of (bundle, x, c, n, d): enough to meet every similar set that shares some.

    Two sets that differ by T at most and first share what is at p and q have
    p + q <= T, which is v + w <= 0 for their ``v``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, classes = crowd.value
        rank = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
        rank[slots] = classes
        for b in batches:
            parts, length = [], []
            n = b.column(3).to_numpy()
            most = _apart(n, n * WHOLE // SHARE) + 1
            d = b.column(4).to_pylist()
            for bundle, x, k in zip(b.column(0).to_pylist(), d, most.tolist(), strict=True):
                token = np.sort(_tokens(bundle, np.frombuffer(x, np.uint64)))
                parts.append(token[np.argsort(rank[slot_of(token)], kind="stable")][:k])
                length.append(len(parts[-1]))
            length = np.array(length, dtype=np.int64)
            pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            wide = lambda c, length=length: np.repeat(c, length)
            v = _reach(wide(n), pos)
            yield pa.record_batch(
                [pa.array(_signed(np.concatenate([np.empty(0, np.uint64), *parts]))), pa.array(v), *(pa.array(wide(b.column(k).to_numpy())) for k in range(3)), pa.array(wide(np.fromiter(map(len, d), np.int64, len(d))))],
                names=[y.split(" ")[0] for y in _OFFERS.split(", ")],
            )

    return run


_MET = "kind int, run long, bundle long, x long, size long"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From _OFFERS by token and v: who meets in runs of several components.

    Sets that can have no partner in their run, by its least v, are left out.  A run
    of the others is named by them (kind 0), so that differences of the same sets
    are one run; one of more than DIRECT sets or of too many bytes is passed on by
    its token (kind 1), without being held.
    """
    names = [y.split(" ")[0] for y in _MET.split(", ")]

    def rows(kind: int, run, bundle, x, size) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(x), kind, dtype=np.int32)), pa.array(run), pa.array(bundle), pa.array(x), pa.array(size)], names=names)

    def told(token, v, bundle, x, c, size) -> Iterator[pa.RecordBatch]:
        begin, length = _runs_of(token)
        if not len(begin):
            return
        able = v <= -np.repeat(v[begin], length)
        token, bundle, x, c, size = (y[able] for y in (token, bundle, x, c, size))
        begin, length = _runs_of(token)
        if not len(begin):
            return
        several = np.minimum.reduceat(c, begin) != np.maximum.reduceat(c, begin)
        large = (length > DIRECT) | ((np.add.reduceat(size, begin) > DIRECT_BYTES) & (length > PAIRED))
        more = np.repeat(several & large, length)
        if more.any():
            yield rows(1, token[more], bundle[more], x[more], size[more])
        few = np.repeat(several & ~large, length)
        if few.any():
            name = mix(np.add.reduceat(mix(x.view(np.uint64) + np.uint64(1)), begin) ^ mix(bundle[begin].view(np.uint64)))
            name = np.repeat(_signed(name), length)[few]
            bundle, x, size = bundle[few], x[few], size[few]
            order = np.lexsort((x, name))
            name, bundle, x, size = (y[order] for y in (name, bundle, x, size))
            new = np.append(True, (name[1:] != name[:-1]) | (x[1:] != x[:-1]))
            yield rows(0, name[new], bundle[new], x[new], size[new])

    carry, open_run = None, None
    for b in batches:
        cols = [b.column(k).to_numpy() for k in range(6)]
        if open_run is not None:
            k = int(np.searchsorted(cols[0], open_run[0], "right"))
            on = cols[1][:k] <= open_run[1]
            if on.any():
                yield rows(1, *(cols[i][:k][on] for i in (0, 2, 3, 5)))
            cols = [y[k:] for y in cols]
        if not len(cols[0]):
            continue
        open_run = None
        if carry is not None:
            cols = [np.concatenate(y) for y in zip(carry, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        yield from told(*(y[:cut] for y in cols))
        on = cols[1][cut:] <= -cols[1][cut]
        carry = [y[cut:][on] if on[0] else y[cut : cut + 1] for y in cols]
        if len(carry[0]) > DIRECT:
            yield rows(1, *(carry[i] for i in (0, 2, 3, 5)))
            open_run, carry = (carry[0][0], -carry[1][0]), None
    if carry is not None:
        yield from told(*carry)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How much each two of the sets have in common."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[which] > 1
    who, which = who[shared], column[which[shared]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(1, (1 << 24) // len(sets))
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        i, j = np.searchsorted(which, [lo, lo + width])
        block = np.zeros((len(sets), min(width, int(which[-1]) + 1 - lo)), dtype=np.float32)
        block[who[i:j], which[i:j] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (run, x, c, n, d) by run: links between components, a forest of them for each run."""

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        x, c, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))
        d = [np.frombuffer(r[4], np.int64) for r in rows]
        size = np.array([len(s) for s in d])
        i, j = np.nonzero(np.triu((c[:, None] != c) & (size[:, None] + size - 2 * _common(d) <= _apart(n[:, None], n)), 1))
        up: dict[int, int] = {}

        def root(k: int) -> int:
            while (y := up.get(k, k)) != k:
                k = y
            return k

        out = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(int(c[a])), root(int(c[b]))
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((min(x[a], x[b]), max(x[a], x[b])))
        if out:
            yield pa.record_batch([pa.array([y[k] for y in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if held and r[0] != held[0][0]:
                yield from links(held)
                held = []
            held.append(r)
    if held:
        yield from links(held)


def _by_differences(spark: SparkSession, docs: DataFrame, bundles: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` and all that is missing between components among the sets that have one leader in ``bundles`` (leader, x)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = _sets_of(spark, docs, bundles.withColumnsRenamed({"leader": "a", "x": "b"}), "open-sets")
    while True:
        pairs = bundles.join(sets.withColumnsRenamed({"id": "x", "shingles": "v"}), "x").join(sets.withColumnsRenamed({"id": "leader", "shingles": "u"}), "leader")
        apart = write_table(spark, pairs.select("leader", "x", "u", "v").mapInArrow(_differences, _DIFFERENCES), "differences")
        links = links.union(apart.where("near").select(F.least("leader", "x").alias("a"), F.greatest("leader", "x").alias("b")))
        nodes = components(spark, links, SMALL_EDGES)
        names = write_table(spark, _labelled(apart.select("bundle", "x").distinct(), nodes), "labelled")
        names = names.join(broadcast_if_small(write_table(spark, _still_open(names, ["bundle"]), "open")), "bundle")
        rows = apart.select("bundle", "x", "n", "d").join(broadcast_if_small(names), ["bundle", "x"]).select("bundle", "x", "c", "n", "d")
        rows = write_table(spark, rows, "open-differences")
        if rows.isEmpty():
            return links
        crowd = spark.sparkContext.broadcast(_frequent(rows))
        offers = rows.mapInArrow(_offers(crowd), _OFFERS).repartition(parts, "token").sortWithinPartitions("token", "v")
        met = write_table(spark, offers.mapInArrow(_meetings, _MET), "met")
        runs = met.where("kind = 0").select("run", "bundle", "x").distinct().join(rows, ["bundle", "x"]).select("run", "x", "c", "n", "d")
        found = runs.repartition(parts, "run").sortWithinPartitions("run").mapInArrow(_verify, "a long, b long")
        links = links.union(write_table(spark, found.distinct(), "found-links"))
        nodes = components(spark, links, SMALL_EDGES)
        # Crowded runs go on with the set that differs least from their old leader.
        more = _labelled(met.where("kind = 1").select("run", "x", "size"), nodes)
        lead = more.groupBy("run").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("x", "size").alias("leader")).where("low != high").select("run", "leader")
        bundles = write_table(spark, more.join(lead, "run").where("x != leader").select("leader", "x").distinct(), "bundles")
        if bundles.isEmpty():
            return links


def components_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    Words are runs of other characters than blank, tab, newline, vertical tab, form
    feed and carriage return, A-Z lower-cased; a set is the distinct five-word
    shingles, of shorter texts the whole sequence.  Texts link when 100 times the
    common shingles are at least 75 times all; component_id is the least doc_id
    that links reach.  A text without words (or null) has 0 shingles and itself as
    component.  Rows of one doc_id are one node; a null doc_id is a member of its
    set's component (null if it alone has the set) but no node.  Repeated rows each
    give a row; an empty table gives none; other columns are not read.
    """
    base = pick(docs, ["doc_id", "text"])
    crowd = spark.sparkContext.broadcast(crowded_slots(base))
    members = write_table(spark, base.mapInArrow(_describe(crowd), _ROWS), "members")
    known = members.where("n > 0 and doc_id is not null")
    sets = write_table(spark, known.groupBy("grp", "n", "signature").agg(F.min("doc_id").alias("rep"), F.first("histogram").alias("histogram")), "sets")  # distinct texts
    several = write_table(spark, sets.groupBy("grp").agg(F.min("rep").alias("head"), F.count(F.lit(1)).cast("int").alias("sets")).where("sets > 1"), "several")
    inside = write_table(spark, sets.select("grp", "rep", "n").join(broadcast_if_small(several), "grp"), "shared-prefix")

    # Groups, by the doc_id of their least member, meet at the shingles of their prefixes.
    groups = _groups(spark, known, several)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = groups.mapInArrow(_postings(crowd), _POSTINGS).repartition(parts, "token", "salt").sortWithinPartitions("token", "place", "grp")
    met = write_table(spark, postings.mapInArrow(_first_pairs, _PAIRS), "meetings")

    # From here on groups are expanded to their sets.
    of = broadcast_if_small(inside.select("head", "rep"))
    expand = lambda df, c: df.join(of.withColumnsRenamed({"head": c, "rep": f"{c}_rep"}), c, "left").withColumn(c, F.coalesce(f"{c}_rep", c)).drop(f"{c}_rep")
    small = met.where("kind = 0").select("a", "b").distinct()
    small = expand(expand(small, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    postings = lambda kind: expand(met.where(f"kind = {kind}").select("token", F.col("a").alias("x"), "place"), "x").select("token", "x", "place")
    runs = broadcast_if_small(postings(1)).join(sets.select(F.col("rep").alias("x"), "histogram"), "x").select("token", "x", "place", "histogram")
    told = write_table(spark, runs.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_screened, _PAIRS), "screened")
    small = small.union(told.where("kind = 0").select("a", "b"))
    crowded = told.where("kind = 1").select("token", F.col("a").alias("x"), "place")
    crowded = crowded.union(postings(2)).union(inside.select(F.xxhash64("grp").alias("token"), F.col("rep").alias("x"), F.shiftleft("n", 32).alias("place")))
    stars = write_table(spark, _with_leaders(crowded), "stars")
    pairs = write_table(spark, small.union(_star_pairs(stars)).where("a != b").distinct(), "first-pairs")
    links = _verified(spark, base, pairs, sets, "first")
    nodes = components(spark, links, SMALL_EDGES)

    # Runs of several components go on with the leader that has most links.
    apart = _labelled(stars.drop("mask"), nodes)
    still = write_table(spark, _still_open(apart, _MEMBERS), "open-runs")
    degree = links.select(F.explode(F.array("a", "b")).alias("leader")).groupBy("leader").agg(F.count(F.lit(1)).alias("degree"))
    ranked = still.select(*_MEMBERS, F.explode(F.array(*_MEMBERS)).alias("leader")).join(degree, "leader", "left")
    best = ranked.groupBy(*_MEMBERS).agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "leader")).alias("best")).select(*_MEMBERS, "best.leader")
    bundles = write_table(spark, stars.join(broadcast_if_small(write_table(spark, best, "best")), _MEMBERS).where("x != leader").select("leader", "x").distinct(), "bundles")
    if not bundles.isEmpty():
        links = _by_differences(spark, base, bundles, links, nodes)
        nodes = components(spark, links, SMALL_EDGES)

    named = sets.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").select("grp", "n", "signature", F.coalesce("component", "rep").alias("set_in"))
    out = members.join(named, ["grp", "n", "signature"], "left")
    # A doc_id of several rows has the least component of its texts.
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("set_in", "doc_id").alias("component_id"))


def _without(spark: SparkSession, docs: DataFrame, out: DataFrame) -> DataFrame:
    """``docs`` but for the doc_ids in ``out`` (__d).

    Where these are too many to broadcast, a filter of them tells which rows must be
    joined, so that the texts of all others are not shuffled.
    """
    gone = lambda df, ids: df.join(ids, df["doc_id"] == ids["__d"], "left_anti")
    side = broadcast_if_small(out)
    if side is not out:
        return gone(docs, side)
    told = spark.sparkContext.broadcast(_bits_of(out.select(F.col("__d").cast("long"))))

    @F.arrow_udf("boolean")
    def passes(ids: pa.Array) -> pa.Array:
        return pa.array(_passes(told.value, ids.fill_null(0).to_numpy(zero_copy_only=False)))

    asked = F.col("doc_id").isNotNull() & passes(F.col("doc_id").cast("long"))
    return docs.where(~asked).unionByName(gone(docs.where(asked), out))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and one document for each component of similar texts, the least doc_id.

    Rows without a doc_id or without words (null, empty, blank) stay.  Rows that repeat
    a doc_id and its text give one row; a doc_id with several texts stays with all of
    them if one is the least of its component.  Very long texts are compared whole; an empty table gives
    no rows; other columns are carried along and may have any name but ``__d``.
    """
    found = write_table(spark, components_of(spark, docs), "components")
    out = write_table(spark, found.groupBy(F.col("doc_id").alias("__d")).agg(F.max(F.col("component_id") == F.col("doc_id")).alias("own")).where("not own").select("__d"), "copies")
    kept = _without(spark, docs, out)
    often = write_table(spark, found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("__d")), "repeated")
    if often.isEmpty():
        return kept
    often = broadcast_if_small(often)
    return kept.join(often, kept["doc_id"] == often["__d"], "left_anti").unionByName(kept.join(often, kept["doc_id"] == often["__d"], "left_semi").dropDuplicates(["doc_id", "text"]))
