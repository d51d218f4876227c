"""Token-id files coded by canonical, length-limited Huffman codes.

A store is a folder that holds

* ``codes``: one row for each id that occurs: ``id``, ``bits`` (its code length).
  The canonical codes follow from the lengths: ids sorted by (bits, id) get rising
  codes.
* ``blocks``: independent blocks in ascending doc_id order, by (part, first), where
  ``first`` counts the ids of the part before the block.
  ``payload`` is the bit stream, most significant bit first, in big-endian 32-bit
  words; ``checkpoints`` has the bit offset of every ``STRIDE``-th id (little-endian
  unsigned 32-bit), so a block can be entered there and many places be decoded at
  once; ``doc_ids`` and ``doc_tokens`` list its documents.

Both are written by Spark's committers, so a store can lie in any file system.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import pick, scratch_path, write_table

END_ID = 0
#: Longest code; a decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
STRIDE = 64
#: Pieces a worker remembers while it tokenises (some 300 MB at most).
CACHE_PIECES = 1_500_000
#: A block is closed once it holds so many ids.
BLOCK_IDS = 1 << 16
#: Ids that are counted at once while texts are tokenised.
COUNT_IDS = 1 << 18

_BLOCKS = "part int, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, payload binary"
_BLOCK_TYPES = pa.schema(
    [("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())]
)

_IDS = "part int, first long, doc_id long, ids binary, seen array<long>, n array<long>"
_IDS_TYPES = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("seen", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # Each level holds the sorted weights of leaves and packages; of the last, the
    # first 2n - 2 count, and a level's leaves among those counted add a bit each.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < n)
        merged = weights[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= bits - last
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint32)
        code, last = code + len(ids), bits
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each prefix of the longest code's bits."""
    top = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, top - lengths[order].astype(np.int64))
    symbols, bits = np.zeros(1 << top, dtype=np.uint32), np.ones(1 << top, dtype=np.int64)
    end = int(spans.sum())
    symbols[:end] = np.repeat(order, spans)
    bits[:end] = np.repeat(lengths[order], spans)
    return symbols, bits, top


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(checkpoints, payload) of ``ids``."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    word, shift = at >> 5, (64 - bits - (at & 31)).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift
    n = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 1
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return at[::STRIDE].astype("<u4").tobytes(), words.astype(np.uint64).astype(">u4").tobytes()


def decode_block(n_ids: int, checkpoints: bytes, payload: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block: all its checkpoints are entered side by side."""
    symbols, bits, top = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((len(at), STRIDE), dtype="<u4")
    down = np.uint64(64 - top)
    for k in range(STRIDE):
        live = len(at) if (len(at) - 1) * STRIDE + k < n_ids else len(at) - 1
        if not live:
            break
        a = at[:live]
        key = ((pairs[a >> 5] << (a & 31).astype(np.uint64)) >> down).astype(np.int64)
        out[:live, k] = symbols[key]
        at[:live] += bits[key]
    return out.reshape(-1)[:n_ids]


def _ordered_ids(spark: SparkSession, docs: DataFrame, path: str, end_id: int, partitions: int | None) -> DataFrame:
    """part, first, doc_id, ids of every row, written in ascending doc_id order, part after part; behind each part a row of counts.

    ``first`` counts the ids of the part before the document.  The row behind a part has
    the ids in it, ``seen``, and how often each occurs, ``n``, which are null for documents.

    Ids take two bytes where the vocabulary allows it, as planes of low and high
    bytes, which the table's codec compresses better; else four.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, at = bpe.encoder(path, CACHE_PIECES).encode, end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        counter = _IdCounter()
        for b in batches:
            raw = []
            for t in b.column(1).to_pylist():
                ids = encode(t) + end
                counter.add(ids)
                raw.append(_narrow(ids))
            size = np.array([(len(r) - 1) // r[0] for r in raw], dtype=np.int64)
            ends = at + np.cumsum(size)
            yield _ids_batch([np.full(len(raw), part, dtype=np.int32), ends - size, b.column(0), raw, [None] * len(raw), [None] * len(raw)])
            at = int(ends[-1]) if len(raw) else at
        if at:
            seen, n = counter.counts()
            yield _ids_batch([[part], [at], [None], [None], [seen], [n]])

    dealt = pick(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return write_table(spark, dealt.mapInArrow(run, _IDS), "ids")


def _ids_batch(columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _IDS_TYPES.types, strict=True)], schema=_IDS_TYPES)


class _IdCounter:
    """Counts of ids, a bounded run at a time."""

    def __init__(self) -> None:
        self.total = np.zeros(1 << 16, dtype=np.int64)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        """Count little-endian unsigned 32-bit ids."""
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= 4 * COUNT_IDS:
            self._flush()

    def _flush(self) -> None:
        got = np.bincount(np.frombuffer(b"".join(self.held), "<u4"))
        if len(got) > len(self.total):
            self.total = np.append(self.total, np.zeros(len(got) - len(self.total), dtype=np.int64))
        self.total[: len(got)] += got
        self.held, self.size = [], 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids that occur, and how often each does."""
        self._flush()
        seen = np.flatnonzero(self.total)
        return seen, self.total[seen]


def _narrow(raw: bytes) -> bytes:
    """One byte that tells the width, then the ids."""
    ids = np.frombuffer(raw, "<u4")
    if ids.max() < 1 << 16:
        return b"\x02" + (ids & 255).astype(np.uint8).tobytes() + (ids >> 8).astype(np.uint8).tobytes()
    return b"\x04" + raw


def _wide(data: bytes) -> np.ndarray:
    if data[0] == 2:
        n = len(data) // 2
        return np.frombuffer(data, np.uint8, n, 1).astype("<u4") | (np.frombuffer(data, np.uint8, n, 1 + n).astype("<u4") << 8)
    return np.frombuffer(data, "<u4", offset=1)


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs, by the rows of counts of the written table; as long as the vocabulary."""
    parts = ids.where(F.col("seen").isNotNull()).select(F.inline(F.arrays_zip("seen", "n")))
    rows = parts.groupBy("seen").agg(F.sum("n").alias("n")).toArrow()  # a row for each id
    seen, n = rows["seen"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(int(seen.max(initial=END_ID)) + 1, dtype=np.int64)
    counts[seen] = n
    return counts


def write_store(spark: SparkSession, docs: DataFrame, folder: str, path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every text of ``docs`` and write a store to ``folder``.

    Ids are those of the tokenizer file at ``path`` without added tokens, then
    ``end_id``; a null or empty text is that id alone.  Documents are in ascending
    doc_id order, nulls first, repeated rows each written, equal doc_ids by the
    hash of their text.  An empty table gives a store without blocks.

    The texts are range-partitioned by doc_id and tokenised once; the ids are counted in
    that pass and written in order with their counts (at most a row for each id and task
    is shuffled to add these up), then coded where they lie.  No text is collected.
    """
    ids = _ordered_ids(spark, docs, path, end_id, partitions)
    lengths = code_lengths(id_counts(ids))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of runs of documents of one part."""
        lens, codes = shared.value
        names: list = []
        raws: list[np.ndarray] = []
        held, part, at = 0, -1, 0

        def close() -> pa.RecordBatch:
            nonlocal names, raws, held
            all_ids = np.concatenate(raws)
            checkpoints, payload = encode_block(all_ids, codes, lens)
            row = [[part], [at], [len(all_ids)], [names], [[len(r) for r in raws]], [checkpoints], [payload]]
            names, raws, held = [], [], 0
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, _BLOCK_TYPES.types, strict=True)], schema=_BLOCK_TYPES)

        for b in batches:
            for p, k, doc_id, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if names and p != part:
                    yield close()
                if not names:
                    part, at = p, k
                names.append(doc_id)
                raws.append(_wide(data))
                held += len(raws[-1])
                if held >= BLOCK_IDS:
                    yield close()
        if names:
            yield close()

    ids.where(F.col("seen").isNull()).select("part", "first", "doc_id", "ids").mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Decode a store: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    codes = spark.read.schema("id int, bits int").parquet(f"{folder}/codes").toArrow()  # at most a row for each id
    ids = codes["id"].to_numpy()
    lengths = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.uint8)
    lengths[ids] = codes["bits"].to_numpy()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each part
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for b in batches:
            for r in b.to_pylist():
                raw = decode_block(r["n_ids"], r["checkpoints"], r["payload"], table).tobytes()
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - r["doc_tokens"]
                yield pa.record_batch(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(starts + (before[r["part"]] + r["first"]), pa.int64()),
                        pa.array(r["doc_tokens"], pa.int64()),
                        pa.array([raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` as a store in the shared folder and digest what is read back."""
    folder = scratch_path(spark, "huffman-store")
    write_store(spark, docs, folder, path)
    return read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    """The digest of a document's ids, for comparison."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
