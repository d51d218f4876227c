from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from conftest import png as write

from prismal.functions.decode import decode, png


@pytest.mark.parametrize("shape", [(5, 7), (6, 3, 3), (4, 9, 4)])
def test_plain(shape):
    a = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    assert (png(write(a)) == a).all() and (decode(write(a)) == a).all()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_filters(kind):
    a = np.random.default_rng(kind).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    flat = a.reshape(6, 15).astype(int)
    left = np.hstack([np.zeros((6, 3), int), flat[:, :-3]])
    up = np.vstack([np.zeros((1, 15), int), flat[:-1]])
    corner = np.hstack([np.zeros((6, 3), int), up[:, :-3]])
    p = left + up - corner
    d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
    paeth = np.choose(d.argmin(axis=0), [left, up, corner])
    guess = {1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]
    rows = b"".join(bytes([kind]) + ((flat - guess) % 256).astype(np.uint8)[y].tobytes() for y in range(6))
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (png(data) == a).all()


def test_broken():
    assert decode(b"") is None and decode(b"\x89PNG\r\n\x1a\n") is None and decode(b"text") is None
