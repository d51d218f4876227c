"""Things that several operators share: scratch tables, column checks, sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when it has at most so many rows and bytes; beyond
#: that the join shuffles on its key.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


#: Scratch tables that this process has written and not yet removed.
_WRITTEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where unset, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="prismal-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Spark removes the shuffle files of a query when the driver collects it as garbage.  A
    driver that has little to do seldom collects, so it is asked to after each table; else
    the files of all queries of an operator would lie on disk together.
    """
    path = scratch_path(spark, name)
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many scratch tables there are now."""
    return len(_WRITTEN)


def remove_scratch(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch tables written after the first ``since``; results not stored yet that read them are lost."""
    while len(_WRITTEN) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(name: str, kind: str) -> Column:
    """About the bytes of a value."""
    if kind in ("string", "binary"):
        return F.octet_length(name)
    if kind.startswith(("array", "map", "struct")):
        return F.octet_length(F.to_json(F.struct(name)))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when counting shows it has at most ``limit`` rows and ``most`` bytes."""
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        width += F.coalesce(_width(f"`{name}`", kind), F.lit(0))
    rows, size = df.limit(limit + 1).select(width.alias("w")).agg(F.count(F.lit(1)), F.sum("w")).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= most else df


def pick(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns can never clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Items that a scan adds up one by one, so that what it copies stays small.
SLICE = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slices(items: Column, size: int = SLICE) -> Column:
    """``items`` cut into arrays of ``size``; none of an empty array."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(size)))


def before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers ``values`` what ``join`` makes of 0 and those before it."""
    none = F.array().cast("array<int>")

    def scan(items: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of(chunks: Column) -> Column:
        whole = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), join))
        return F.flatten(F.zip_with(chunks, scan(whole, F.lit(0)), scan))

    return let(let(values, lambda v: slices(v)), of)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
