"""Scores and flags as Column expressions: 0 is worst, 1 is fine; a null property gives a null score and no flag."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.least(width / height, height / width)


def size(width: Column, height: Column) -> Column:
    return F.sqrt(width.cast("double")) * F.sqrt(height.cast("double"))


def color_space(channels: Column) -> Column:
    return F.when(channels == 1, "L").when(channels == 3, "RGB").when(channels == 4, "RGBA").otherwise(F.when(channels.isNotNull(), "UNK"))


def _at_most_one(x: Column) -> Column:
    return F.when(x > 1, 1.0).otherwise(x)


def dark_score(p: dict[str, Any] | None = None) -> Column:
    return F.col("brightness_perc_99")


def light_score(p: dict[str, Any] | None = None) -> Column:
    return 1 - F.col("brightness_perc_5")


def aspect_score(p: dict[str, Any] | None = None) -> Column:
    return F.col("aspect_ratio")


def entropy_score(p: dict[str, Any]) -> Column:
    return _at_most_one(p["normalizing_factor"] * F.col("entropy"))


def blur_score(p: dict[str, Any]) -> Column:
    rate = p["normalizing_factor"]
    spread = 1 - F.exp(-rate * F.col("blurriness_grayscale_std"))
    return _at_most_one((1 - F.exp(-rate * F.col("blurriness"))) + F.when(spread <= p["color_threshold"], 0.0).otherwise(spread))


def grayscale_score(p: dict[str, Any] | None = None) -> Column:
    return F.when(F.col("color_space") == "L", 0.0).otherwise(F.when(F.col("color_space").isNotNull(), 1.0))


def size_fences(quartiles: Column, factor: float) -> list[Column]:
    """For ``size_score``, from the array of both quartiles: the middle and the width of the fences around them."""
    q = [quartiles[0], quartiles[1]]
    low, high = q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0])
    return [((low + high) / 2).alias("size_middle"), (high - low).alias("size_gap")]


def size_score(column: Column) -> Column:
    norm = F.when(F.col("size_gap") > 0, F.col("size_gap")).otherwise(F.col("size_middle"))
    far = F.abs(column - F.col("size_middle")) / norm
    return 1 - F.when(far > 1, 1.0).otherwise(far)


def size_threshold(given: float | None) -> Column:
    return F.lit(given) if given is not None else F.when(F.col("size_gap") > 0, 0.5).otherwise(1.0)


def flag(score: Column, threshold: Column | float) -> Column:
    return F.coalesce(score < threshold, F.lit(False))


SCORES = {"dark": dark_score, "light": light_score, "odd_aspect_ratio": aspect_score, "low_information": entropy_score, "blurry": blur_score, "grayscale": grayscale_score}
