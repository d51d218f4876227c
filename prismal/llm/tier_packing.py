"""Hierarchical multi-length packing.

Documents are routed to a context tier (window) by their length.  Each tier is
packed in turn, longest window first: an item of the tier opens a sequence and
the gap it leaves is filled from the same and the shorter tiers, cutting the last
filler so that the sequence ends exactly at the window.  What remains when the
input of a partition ends is laid out in windows that are powers of two, so no
sequence needs padding.  Sequences of a tier are dealt into step groups of the same
number of tokens; the last group of each window in a partition may hold fewer.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .shared import pick

#: Context sizes, longest first; all are powers of two.
WINDOWS = (1024, 512, 256, 128)
#: Tokens in a step group: eight of the longest windows.
STEP_TOKENS = 8 * 1024
#: Items that wait for partners before their tier is packed.
POOL = 4096
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


class TierPacker:
    """Packs documents of one partition; ``emit`` gets finished sequences as (window, pieces)."""

    def __init__(self, windows: tuple[int, ...] = WINDOWS, pool: int = POOL):
        if any(w & (w - 1) for w in windows) or list(windows) != sorted(set(windows), reverse=True):
            raise ValueError("windows must be powers of two, longest first")
        self.windows, self.limit = windows, pool
        self.items: list[tuple[int, int, int]] = []  # (length, key, start), sorted; the pool of all tiers
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []  # (window, [(key, start, length)])

    def add(self, key: int, n: int) -> None:
        """Route a document of ``n`` tokens: whole longest windows stand alone, the rest joins a tier."""
        w = self.windows[0]
        full = n - n % w
        for s in range(0, full, w):
            self.done.append((w, [(key, s, w)]))
        if n > full:
            insort(self.items, (n - full, key, full))
        if len(self.items) >= self.limit:
            self._pack(keep=self.limit // 2)

    def _fill(self, window: int, opener: tuple[int, int, int]) -> None:
        n, key, start = opener
        if n > window:  # of a longer tier that could not be filled
            insort(self.items, (n - window, key, start + window))
            n = window
        pieces, gap = [(key, start, n)], window - n
        while gap:
            at = bisect_right(self.items, (gap, float("inf"), 0)) - 1
            if at >= 0:  # the longest that still fits: from a shorter tier, or the same
                n, key, start = self.items.pop(at)
                pieces.append((key, start, n))
                gap -= n
            else:  # all are too long: cut the shortest
                n, key, start = self.items.pop(0)
                pieces.append((key, start, gap))
                insort(self.items, (n - gap, key, start + gap))
                gap = 0
        self.done.append((window, pieces))

    def _pack(self, keep: int) -> None:
        """Pack tier after tier until ``keep`` items are left."""
        tokens = sum(i[0] for i in self.items)
        for k, w in enumerate(self.windows):
            shorter = self.windows[k + 1] if k + 1 < len(self.windows) else 0
            while len(self.items) > keep and tokens >= w:
                at = bisect_left(self.items, (shorter + 1, -1, -1))
                if at >= len(self.items) or self.items[-1][0] <= shorter:
                    break
                self._fill(w, self.items.pop())
                tokens -= w

    def finish(self) -> None:
        """Lay out what is left: windows while they can be filled, then powers of two."""
        self._pack(keep=0)
        left = sum(i[0] for i in self.items)
        while left:
            w = min(1 << (left.bit_length() - 1), self.windows[0])
            self._fill(w, self.items.pop())
            left -= w

    def take(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, path: str, windows: tuple[int, ...] = WINDOWS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID, memo: int = bpe.CACHE_PIECES) -> DataFrame:
    """Pack every text of ``docs`` into sequences; one row for each piece of a document.

    A document is its ids by the tokenizer file at ``path`` followed by ``end_id``;
    a null or empty text is that id alone.  Columns: doc_id, start (ids of the
    document before the piece), length, ids_crc32, doc_tokens, sequence_id, offset
    in the sequence, window, step_group.  Each id lies in one piece, sequences are
    gapless and exactly a power of two long, so padding is 0.  Repeated rows are
    packed each; a null doc_id is kept; an empty table gives no rows.

    ``memo`` bounds the pieces that a worker remembers: fewer take longer and less memory.

    The pass is narrow: partitions are packed on their own (ids carry the partition
    number), so there is no shuffle, and a lost task packs the same rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = bpe.encoder(path, memo).encode, end_id.to_bytes(4, "little")
        base, packer = TaskContext.get().partitionId() << 40, TierPacker(windows)
        waiting: dict[int, list] = {}  # key: doc_id, ids, tokens, tokens not yet placed
        key = sequence = 0
        groups: dict[int, list[int]] = {}  # window: group, tokens in it
        n_groups = 0

        def rows(sequences) -> pa.RecordBatch:
            nonlocal sequence, n_groups
            cols: list[list] = [[] for _ in _NAMES]
            for window, pieces in sequences:
                g = groups.get(window)
                if g is None or g[1] + window > step_tokens:
                    g = groups[window] = [n_groups, 0]
                    n_groups += 1
                g[1] += window
                offset = 0
                for k, start, n in pieces:
                    doc = waiting[k]
                    crc = zlib.crc32(doc[1][4 * start : 4 * (start + n)])
                    for c, v in zip(cols, (doc[0], start, n, crc, doc[2], base + sequence, offset, window, base + g[0]), strict=True):
                        c.append(v)
                    offset += n
                    doc[3] -= n
                    if not doc[3]:
                        del waiting[k]
                sequence += 1
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                waiting[key] = [doc_id, ids, n, n]
                packer.add(key, n)
                key += 1
                if len(packer.done) >= POOL:
                    yield rows(packer.take())
        packer.finish()
        yield rows(packer.take())

    return pick(docs, ["doc_id", "text"]).mapInArrow(run, SCHEMA)
