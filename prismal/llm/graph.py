"""Connected components in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import write_table

#: So many edges at most are joined in one task; more take distributed rounds.
SMALL_EDGES = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all batches."""
    up: dict = {}

    def root(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(up.setdefault(x, x)), root(up.setdefault(y, y))
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        yield pa.record_batch([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], names=["node", "component"])


def components_small(edges: DataFrame) -> DataFrame:
    """``components`` of a table whose size was checked, in one task."""
    kind = edges.schema[0].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")


def components(spark: SparkSession, edges: DataFrame, small: int = 0) -> DataFrame:
    """(node, component) for the two-column ``edges``; component is the least node reachable.

    Rounds of two steps: every node hands its larger neighbours its least one, then
    its smaller neighbours theirs, until each component is a star around its least
    node.  Whole trees are hooked at once, so that long chains in any order take a
    number of rounds like the logarithm of their length.  Rounds are written to the
    shared folder; a hub is one row on the small side of each join, and adaptive
    execution splits its links on the other.  Nulls and loops link nothing; a node
    without a link to another has no row.  With ``small``, a table of at most so many
    edges (it is counted) is joined in one task; the result is the same.
    """
    a, b = edges.columns
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    if small and one.limit(small + 1).count() <= small:
        return write_table(spark, components_small(one), "components")
    links = write_table(spark, _larger_first(one), "links")
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Of links (v, u) with v > u; those of a node that is its own least one stay as they are.
        hung = links.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct()
        hung = write_table(spark, hung, "links")
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        rest = hung.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = write_table(spark, _larger_first(least.select("a", F.col("m").alias("b")).union(rest)), "links")
        same = after.join(links, ["a", "b"], "left_anti").isEmpty() and links.join(after, ["a", "b"], "left_anti").isEmpty()
        links = after
        if same:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _larger_first(pairs: DataFrame) -> DataFrame:
    """Distinct links, each as (a, b) with a > b."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
