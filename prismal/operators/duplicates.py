"""Exact and near duplicates: equal hashes, counted by aggregation rather than by lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import flag_column, score_column


def set_sizes(df: DataFrame, hash_name: str) -> DataFrame:
    """A row for each hash that two or more rows have: hash, set_size, first_ord."""
    groups = df.where(F.col(hash_name).isNotNull()).groupBy(hash_name).agg(F.count(F.lit(1)).alias("set_size"), F.min("ord").alias("first_ord"))
    return groups.where("set_size > 1")


def near_only(df: DataFrame, near: str, exact: str) -> DataFrame:
    """The near hashes of two or more rows whose set is not one whole exact set: hash, set_size, first_ord.

    A near set is the same as an exact set when all its rows share one exact hash and
    that hash has no other rows.
    """
    n_exact = df.where(F.col(exact).isNotNull()).groupBy(exact).agg(F.count(F.lit(1)).alias("n_exact"))
    groups = (
        df.where(F.col(near).isNotNull())
        .groupBy(near)
        .agg(F.count(F.lit(1)).alias("set_size"), F.min("ord").alias("first_ord"), F.min(exact).alias("low"), F.max(exact).alias("high"), F.count(exact).alias("hashed"))
        .where("set_size > 1")
    )
    same = (F.col("low") == F.col("high")) & (F.col("hashed") == F.col("set_size")) & (F.col("n_exact") == F.col("set_size"))
    joined = groups.join(n_exact.withColumnRenamed(exact, "low"), "low", "left")
    return joined.where(~F.coalesce(same, F.lit(False))).select(near, "set_size", "first_ord")


def score_and_flag(size: Column, issue: str) -> list[Column]:
    """1 / set size and whether there is a set; 1 and false outside of sets."""
    return [F.when(size > 1, 1.0 / size).otherwise(1.0).alias(score_column(issue)), F.coalesce(size > 1, F.lit(False)).alias(flag_column(issue))]


def flagged(df: DataFrame, sets: DataFrame, hash_name: str, issue: str) -> DataFrame:
    """``df`` with the score and the flag of ``issue``; a hot hash only meets its one row of ``sets``."""
    size = sets.select(F.col(hash_name), F.col("set_size").alias("__n"))
    return df.join(size, hash_name, "left").select(*[df[c] for c in df.columns if c != hash_name], hash_name, *score_and_flag(F.col("__n"), issue))


def members(df: DataFrame, sets: DataFrame, hash_name: str) -> DataFrame:
    """set_id, image_id, ord, set_size: a row for each member, however large a set is."""
    return df.join(sets, hash_name).select(F.col("first_ord").alias("set_id"), "image_id", "ord", "set_size")


def as_lists(member_rows: DataFrame, most: int | None = None) -> DataFrame:
    """set_id, members, set_size with members in order; ``most`` shows only so many of each set."""
    rows = member_rows
    if most is not None:
        from pyspark.sql import Window

        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("set_id").orderBy("ord"))).where(F.col("k") <= most)
    listed = rows.groupBy("set_id", "set_size").agg(F.sort_array(F.collect_list(F.struct("ord", "image_id"))).alias("m"))
    return listed.select("set_id", F.transform("m", lambda x: x["image_id"]).alias("members"), "set_size")
