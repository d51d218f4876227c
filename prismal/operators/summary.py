"""Aggregates over issue frames: counts, statistics, prevalence, the worst rows, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import flag_column, score_column
from .quantiles import exact_quantiles


def counts(issues: DataFrame, types: Sequence[str]) -> DataFrame:
    """issue_type, num_images from one aggregate over all flags."""
    one = issues.agg(*[F.coalesce(F.sum(F.col(flag_column(t)).cast("long")), F.lit(0)).alias(t) for t in types])
    pairs = ", ".join(f"'{t}', `{t}`" for t in types)
    return one.selectExpr(f"stack({len(types)}, {pairs}) as (issue_type, num_images)")


def ordered(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("num_images"), "issue_type")


def describe(df: DataFrame, column: str) -> DataFrame:
    """statistic, value of a number: count, mean, std, min, quartiles, max. Exact; nulls are left out."""
    one = df.agg(F.count(column).cast("double").alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    one = one.crossJoin(F.broadcast(exact_quantiles(df, column, (0.25, 0.5, 0.75))))  # one row each
    return one.selectExpr("stack(8, 'count', count, 'mean', mean, 'std', std, 'min', min, '25%', q[0], '50%', q[1], '75%', q[2], 'max', max) as (statistic, value)")


def describe_category(df: DataFrame, column: str) -> DataFrame:
    """statistic, value (text) of a category: count, unique, top, freq."""
    each = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count(F.lit(1)).alias("unique"), F.max(F.struct("n", column)).alias("top"))
    return one.selectExpr("stack(4, 'count', string(count), 'unique', string(unique), 'top', string(top.`" + column + "`), 'freq', string(top.n)) as (statistic, value)")


def prevalent(summary: DataFrame, total: int, most: float) -> DataFrame:
    """The rows of ``summary`` whose share of all images is below ``most``."""
    return summary.where(F.col("num_images") / F.lit(float(max(total, 1))) < most)


def worst(issues: DataFrame, issue: str, k: int) -> DataFrame:
    """The ``k`` flagged rows with the lowest scores, ties in order."""
    return issues.where(F.col(flag_column(issue))).orderBy(score_column(issue), "ord").limit(k)


def worst_of_each(issues: DataFrame, types: Sequence[str], k: int) -> DataFrame:
    """issue_type, rank, image_id, ord, score of the ``k`` worst flagged rows of every type, in one pass."""
    long = issues.select("image_id", "ord", F.explode(F.array(*[F.struct(F.lit(t).alias("issue_type"), F.col(score_column(t)).alias("score"), F.col(flag_column(t)).alias("flag")) for t in types])).alias("x"))
    rank = F.row_number().over(Window.partitionBy("issue_type").orderBy("score", "ord"))
    return long.where("x.flag").select("x.issue_type", "image_id", "ord", "x.score").withColumn("rank", rank).where(F.col("rank") <= k)


def merged(old: DataFrame, new: DataFrame, key: str = "image_id", overwrite: bool = True) -> DataFrame:
    """Columns of ``new`` joined to ``old``; columns in both are taken from ``new`` if ``overwrite``."""
    both = [c for c in new.columns if c in old.columns and c != key]
    left = old.drop(*both) if overwrite else old
    right = new if overwrite else new.drop(*both)
    return left.join(right, key, "left")


def upserted(summary: DataFrame, new: DataFrame) -> DataFrame:
    """``summary`` with the rows of ``new`` in place of those of the same issue_type."""
    return summary.join(new, "issue_type", "left_anti").unionByName(new)


def deep_merged(old: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
    """``old`` overlaid by ``new``; where both have a dictionary, these are merged in turn. Neither is changed."""
    out = dict(old)
    for name, value in new.items():
        before = out.get(name)
        out[name] = deep_merged(before if isinstance(before, dict) else {}, value) if isinstance(value, dict) else value
    return out
