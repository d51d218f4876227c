"""Exact quantiles without one task that holds all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that are ranked by themselves.
RANGES = 256


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with ``q``: the linearly interpolated quantiles of ``column`` at ``shares``; null where it has no value.

    Equal values are counted first, so that a frequent one is a single row.  A sketch
    cuts the values into RANGES ranges of about the same size; the number of rows in
    each tells which ranges hold the wanted ranks, and only these are sorted, each by
    itself.  The sketch decides the sizes of the ranges and nothing of the result.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    cuts = values.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.crossJoin(F.broadcast(cuts)).select("v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))  # one row

    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # RANGES rows
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = dealt.groupBy("range").agg(F.sum("n").alias("size")).withColumns({"upto": F.sum("size").over(every), "all": F.sum("size").over(whole)})
    at = [(F.col("all").cast("double") - 1) * float(s) for s in shares]
    ranks = F.array(*[r.cast("long") for a in at for r in (F.floor(a), F.ceil(a))])
    wanted = sizes.select("range", (F.col("upto") - F.col("size")).alias("before"), "upto", F.array(*at).alias("at"), ranks.alias("ranks"))
    wanted = wanted.where(F.exists("ranks", lambda r: (r >= F.col("before")) & (r < F.col("upto"))))

    inside = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.join(F.broadcast(wanted), "range").withColumn("end", F.col("before") + F.sum("n").over(inside))
    start = F.col("end") - F.col("n")
    low = [F.max(F.when((start <= F.col("ranks")[2 * k]) & (F.col("ranks")[2 * k] < F.col("end")), F.col("v"))).alias(f"l{k}") for k in range(len(shares))]
    high = [F.max(F.when((start <= F.col("ranks")[2 * k + 1]) & (F.col("ranks")[2 * k + 1] < F.col("end")), F.col("v"))).alias(f"h{k}") for k in range(len(shares))]
    one = ranked.agg(F.max("at").alias("at"), *low, *high)
    between = lambda k: F.when(F.col(f"l{k}") == F.col(f"h{k}"), F.col(f"l{k}")).otherwise((F.ceil(F.col("at")[k]) - F.col("at")[k]) * F.col(f"l{k}") + (F.col("at")[k] - F.floor(F.col("at")[k])) * F.col(f"h{k}"))
    return one.select(F.array(*[between(k) for k in range(len(shares))]).alias("q"))
