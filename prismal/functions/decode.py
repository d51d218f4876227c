"""Encoded bytes to pixels: PNG here, other formats where Pillow can be imported."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG color type: gray, RGB, palette, gray and alpha, RGBA.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of (rows, bytes); ``step`` bytes make a pixel."""
    out = np.zeros_like(raw)
    above = np.zeros(raw.shape[1], dtype=np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), raw, strict=True)):
        if kind == 0:
            line = row
        elif kind == 1:
            line = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = row + above
        else:
            a, up, done = row.tolist(), above.tolist(), [0] * len(row)
            for x in range(len(a)):
                left = done[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    corner = up[x - step] if x >= step else 0
                    p = left + up[x] - corner
                    near = (abs(p - left), abs(p - up[x]), abs(p - corner))
                    guess = left if near[0] <= near[1] and near[0] <= near[2] else up[x] if near[1] <= near[2] else corner
                done[x] = (a[x] + guess) & 255
            line = np.array(done, dtype=np.uint8)
        out[y] = above = line
    return out


def png(data: bytes) -> np.ndarray:
    """(h, w) gray, (h, w, 3) or (h, w, 4) pixels of an 8-bit PNG without interlacing."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] != 0:
        raise ValueError("only 8-bit PNG without interlacing")
    w, h, _, color = head[:4]
    step = _SAMPLES[color]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    a = _unfiltered(rows[:, 1:], rows[:, 0], step).reshape(h, w, step)
    if color == 3:
        return palette[a[:, :, 0]]
    return a[:, :, 0] if step <= 2 else a


def decode(data: bytes) -> np.ndarray | None:
    """Pixels as the kernels take them; null if the bytes cannot be decoded."""
    try:
        if data[:8] == _SIGNATURE:
            try:
                return png(data)
            except (KeyError, TypeError, ValueError):
                pass
        from PIL import Image

        with Image.open(io.BytesIO(data)) as im:
            return np.asarray(im if im.mode in ("L", "RGB", "RGBA") else im.convert("RGB"))
    except Exception:  # a broken image is a row without one
        return None
