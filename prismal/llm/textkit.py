"""Words and word windows of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than blank, tab, newline, vertical tab, form feed
and carriage return.  Hashes are 64 bits and the same in every process; two
different words or windows are taken for equal with a chance of about 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of a chunk that are hashed at once.
_SLAB = 1 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256), _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS


@dataclass
class Chunk:
    """Texts ``lo`` to ``hi`` of a batch, joined by newlines."""

    lo: int
    hi: int
    data: np.ndarray  # bytes
    begin: np.ndarray  # first byte of each text
    end: np.ndarray  # behind the last byte of each text
    starts: np.ndarray  # first byte of each word
    hashes: np.ndarray  # of each word
    first: np.ndarray  # index of each text's first word; one more at the end

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes, a slab of words at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLAB, "right")))
        s, e = starts[i:j], ends[i:j]
        length = e - s
        at = np.cumsum(length) - length
        within = np.arange(int(at[-1] + length[-1])) - np.repeat(at, length)
        values = data[within + np.repeat(s, length)].astype(np.uint64) + np.uint64(1)
        values *= _powers(int(length.max()))[within]
        out[i:j] = mix(np.add.reduceat(values, at) + length.astype(np.uint64))
        i = j
    return out


def chunks(texts: list[str | None], lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch into chunks of about ``limit`` bytes; null is empty. ``lower``: A-Z to a-z first."""
    lo, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        held.append(raw.lower() if lower else raw)
        size += len(raw) + 1
        if size >= limit or i + 1 == len(texts):
            lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
            end = np.cumsum(lengths + 1) - 1
            data = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
            gap = _WS[data]
            edge = np.flatnonzero(np.diff(gap, prepend=True))
            starts, ends = edge[::2], edge[1::2]
            begin = end - lengths
            yield Chunk(lo, i + 1, data, begin, end, starts, _hash_words(data, starts, ends), np.append(np.searchsorted(starts, begin), len(starts)))
            lo, held, size = i + 1, [], 0


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += hashes[k : k + n]
    return mix(out)


def per_text(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each range."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[end] - total[begin]
