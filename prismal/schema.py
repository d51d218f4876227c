"""Issue types, their default parameters, column names and row types."""

from __future__ import annotations

from typing import Any

VERSION = "0.1.0"

# Issue types and their default parameters.
DEFAULTS: dict[str, dict[str, Any]] = {
    "dark": {"threshold": 0.32},
    "light": {"threshold": 0.05},
    "odd_aspect_ratio": {"threshold": 0.35},
    "low_information": {"threshold": 0.3, "normalizing_factor": 0.1},
    "exact_duplicates": {"hash_type": "md5"},
    "near_duplicates": {"hash_type": "phash", "hash_size": 8},
    "blurry": {"threshold": 0.29, "normalizing_factor": 0.01, "color_threshold": 0.18},
    "grayscale": {},
    "odd_size": {"threshold": None, "iqr_factor": 3.0},
}

# File name endings that are read as images.
EXTENSIONS = ("jpg", "JPG", "jpeg", "JPEG", "gif", "GIF", "jp2", "JP2", "png", "PNG", "tiff", "TIFF", "webp", "WebP", "WEBP")

# Brightness percentiles.
PERCENTILES = (1, 5, 10, 15, 90, 95, 99)

DUPLICATE_TYPES = ("exact_duplicates", "near_duplicates")

#: The property that an issue type scores, and the columns that it needs.
PROPERTY = {
    "dark": "brightness",
    "light": "brightness",
    "odd_aspect_ratio": "aspect_ratio",
    "low_information": "entropy",
    "blurry": "blurriness",
    "grayscale": "color_space",
    "odd_size": "size",
}
COLUMNS = {
    "brightness": [*(f"brightness_perc_{p}" for p in PERCENTILES), "brightness"],
    "aspect_ratio": ["aspect_ratio"],
    "entropy": ["entropy"],
    "blurriness": ["blurriness", "blurriness_grayscale_std"],
    "color_space": ["color_space"],
    "size": ["size"],
}

#: Perceptual hashes; exact ones are of the pixel bytes.
PERCEPTUAL_HASHES = ("whash", "phash", "ahash", "dhash", "chash")
EXACT_HASHES = ("md5",)

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def score_column(issue: str) -> str:
    return f"{issue}_score"


def flag_column(issue: str) -> str:
    return f"is_{issue}_issue"


def merged_params(issue: str, given: dict[str, Any] | None, defaults: dict[str, dict[str, Any]] = DEFAULTS) -> dict[str, Any]:
    """Defaults overlaid by the given values that are not None; names and types are checked."""
    out = dict(defaults[issue])
    for name, value in (given or {}).items():
        if name not in out and name != "threshold":
            raise ValueError(f"{issue} has no parameter {name!r}; it has {sorted(out)}")
        if value is None:
            continue
        if name in ("threshold", "normalizing_factor", "color_threshold", "iqr_factor"):
            if isinstance(value, bool) or not isinstance(value, int | float):
                raise ValueError(f"{name} of {issue} must be a number, not {type(value).__name__}")
            value = float(value)
            if name == "iqr_factor" and value < -0.5:
                raise ValueError(f"iqr_factor of {issue} must be at least -0.5, or the fences would cross")
        out[name] = value
    if issue in DUPLICATE_TYPES:
        kind, size = out.get("hash_type"), out.get("hash_size")
        allowed = EXACT_HASHES if issue == "exact_duplicates" else PERCEPTUAL_HASHES
        if kind not in EXACT_HASHES + PERCEPTUAL_HASHES:
            raise ValueError(f"Hash type {kind!r} is not supported; use one of {allowed}")
        if kind in PERCEPTUAL_HASHES:
            if isinstance(size, bool) or not isinstance(size, int) or size < 2:
                raise ValueError(f"hash_size must be an integer of at least 2, not {size!r}")
            if kind == "whash" and size & (size - 1):
                raise ValueError("hash_size must be a power of 2 for whash")
    return out
