"""Pixel kernels in numpy. Images are (height, width) or (height, width, channels) uint8, channels R, G, B, A."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np

from ..schema import PERCENTILES

#: Longest side of the image on which sharpness is measured.
BLUR_SIDE = 64
#: Fraction bits of the resampling weights.
_BITS = 22


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Spark's image bytes (rows of B, G, R[, A]) as an array."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    return a[:, :, [2, 1, 0, *range(3, channels)]]


def mode(image: np.ndarray) -> str:
    return "L" if image.ndim == 2 else {3: "RGB", 4: "RGBA"}.get(image.shape[2], "UNK")


def _perceived(r, g, b):
    return np.sqrt(0.241 * r * r + 0.691 * g * g + 0.068 * b * b) / 255


def brightness(image: np.ndarray) -> dict[str, float]:
    """Percentiles of the pixels' perceived brightness, and that of the mean color."""
    x = image.astype(np.float64)
    each = x / 255 if x.ndim == 2 else _perceived(x[:, :, 0], x[:, :, 1], x[:, :, 2])
    out = dict(zip((f"brightness_perc_{p}" for p in PERCENTILES), np.percentile(each, PERCENTILES).tolist(), strict=True))
    bands = x.mean(axis=(0, 1)) if x.ndim == 3 and x.shape[2] == 3 else [(x if x.ndim == 2 else x[:, :, 0]).mean()] * 3
    out["brightness"] = float(_perceived(*bands))
    return out


def entropy(image: np.ndarray) -> float:
    """Shannon entropy in bits over the histograms of all bands together."""
    bands = [image] if image.ndim == 2 else [image[:, :, k] for k in range(image.shape[2])]
    counts = np.concatenate([np.bincount(b.ravel(), minlength=256) for b in bands])
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    x = image.astype(np.uint32)
    return ((x[:, :, 0] * 19595 + x[:, :, 1] * 38470 + x[:, :, 2] * 7471 + 32768) >> 16).astype(np.uint8)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


_FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"bicubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


@functools.lru_cache(256)
def _weights(size: int, to: int, kind: str) -> np.ndarray:
    """(to, size) integer weights of an antialiased filter."""
    f, support = _FILTERS[kind]
    scale = size / to
    wide = max(scale, 1.0)
    out = np.zeros((to, size), dtype=np.int64)
    for i in range(to):
        center = (i + 0.5) * scale
        low, high = max(int(center - support * wide + 0.5), 0), min(int(center + support * wide + 0.5), size)
        w = f((np.arange(low, high) - center + 0.5) / wide)
        w = w / w.sum() * (1 << _BITS)
        out[i, low:high] = np.where(w < 0, w - 0.5, w + 0.5).astype(np.int64)
    return out


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip((x + (1 << (_BITS - 1))) >> _BITS, 0, 255)


def resize(image: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """Separable resampling in fixed point, rows first; translucent pixels weigh by their alpha."""
    if image.ndim == 3 and image.shape[2] == 4:
        x = image.astype(np.int64)
        t = x[:, :, :3] * x[:, :, 3:] + 128
        y = _resized(np.concatenate([((t >> 8) + t) >> 8, x[:, :, 3:]], axis=2), width, height, kind)
        a = y[:, :, 3:]
        return np.concatenate([np.where(a > 0, np.minimum(y[:, :, :3] * 255 // np.maximum(a, 1), 255), y[:, :, :3]), a], axis=2).astype(np.uint8)
    return _resized(image.astype(np.int64), width, height, kind).astype(np.uint8)


def _resized(x: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    if x.shape[1] != width:
        x = _clipped(np.moveaxis(np.tensordot(_weights(x.shape[1], width, kind), x, axes=(1, 1)), 0, 1))
    if x.shape[0] != height:
        x = _clipped(np.tensordot(_weights(x.shape[0], height, kind), x, axes=(1, 0)))
    return x


def edges(image: np.ndarray) -> np.ndarray:
    """Eight times the pixel less its neighbours, clipped; the border keeps its pixels."""
    out = image.copy()
    if min(image.shape) < 3:
        return out
    x = image.astype(np.int32)
    rows = x[:-2] + x[1:-1] + x[2:]
    block = rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]
    out[1:-1, 1:-1] = np.clip(9 * x[1:-1, 1:-1] - block, 0, 255)
    return out


def blurriness(image: np.ndarray) -> dict[str, float]:
    h, w = image.shape[:2]
    ratio = max(w, h) / BLUR_SIDE
    small = resize(image, max(int(w // ratio), 1), max(int(h // ratio), 1), "bicubic") if ratio > 1 else image
    flat = gray(small)
    return {"blurriness": float(np.sqrt(edges(flat).astype(np.float64).var())), "blurriness_grayscale_std": float(np.bincount(flat.ravel(), minlength=256).std())}


def _hex(bits: np.ndarray) -> str:
    b = np.asarray(bits, dtype=bool).ravel()
    return np.packbits(np.pad(b, (-len(b) % 8, 0))).tobytes().hex()


@functools.lru_cache(16)
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n))


def ahash(image: np.ndarray, size: int) -> str:
    x = resize(gray(image), size, size, "lanczos").astype(np.float64)
    return _hex(x > x.mean())


def dhash(image: np.ndarray, size: int) -> str:
    x = resize(gray(image), size + 1, size, "lanczos")
    return _hex(x[:, 1:] > x[:, :-1])


def phash(image: np.ndarray, size: int) -> str:
    n = 4 * size
    d = _cosines(n)[:size]
    low = d @ resize(gray(image), n, n, "lanczos").astype(np.float64) @ d.T
    return _hex(low > np.median(low))


def whash(image: np.ndarray, size: int) -> str:
    """Means of blocks against their median: the coarse Haar band without its mean."""
    n = max(size, 1 << int(math.log2(max(1, min(image.shape[:2])))))
    x = resize(gray(image), n, n, "lanczos").astype(np.float64)
    low = x.reshape(size, n // size, size, n // size).mean(axis=(1, 3))
    return _hex(low > np.median(low))


def chash(image: np.ndarray, bits: int) -> str:
    """Shares of black, gray, and faint and bright pixels by hue, in ``bits`` bits each."""
    intensity = gray(image)
    rgb = (np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image[:, :, :3]).astype(np.float64)
    top, bottom = rgb.max(axis=2), rgb.min(axis=2)
    span = np.where(top > bottom, top - bottom, 1.0)
    r, g, b = ((top - rgb[:, :, k]) / span for k in range(3))
    turn = np.where(rgb[:, :, 0] == top, b - g, np.where(rgb[:, :, 1] == top, 2 + r - b, 4 + g - r))
    hue = np.where(top > bottom, np.floor(np.fmod(turn / 6 + 1, 1) * 255), 0)
    sat = np.where(top > bottom, np.floor((top - bottom) / np.maximum(top, 1) * 255), 0)
    black = intensity < 256 // 8
    pale = ~black & (sat < 256 // 3)
    colored = ~black & ~pale
    limit, total, most = 256 * 2 // 3, max(1, int(colored.sum())), 1 << bits
    shares = [black.mean(), pale.mean()]
    for part in (colored & (sat < limit), colored & (sat > limit)):
        shares += (np.histogram(hue[part], bins=np.linspace(0, 255, 7))[0] / total).tolist()
    values = [min(most - 1, int(s * most)) for s in shares]
    return _hex(np.array([v >> (bits - 1 - i) & 1 for v in values for i in range(bits)]))


HASHES: dict[str, Callable[[np.ndarray, int], str]] = {"ahash": ahash, "dhash": dhash, "phash": phash, "whash": whash, "chash": chash}
