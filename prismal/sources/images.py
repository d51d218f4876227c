"""Folders, path lists and tables with an image column, as one row type.

Every source returns ``image_id`` (path or row number), ``ord`` (the order that sets
and ties follow), ``name`` and ``image``; an undecodable image has a null ``image``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import decode
from ..schema import EXTENSIONS, IMAGE


def _decoded(image: Column) -> Column:
    return F.when(image["height"] > 0, image)


def _reader(spark: SparkSession, options: dict[str, str] | None):
    return spark.read.format("image").options(**(options or {}))


def _by_path(df: DataFrame, ordinal: Column | None = None) -> DataFrame:
    path = F.col("image.origin")
    key = path if ordinal is None else ordinal
    return df.select(path.alias("image_id"), key.alias("ord"), F.element_at(F.split(path, "/"), -1).alias("name"), _decoded(F.col("image")).alias("image"))


def from_folder(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """All images below ``path`` in any file system that Spark reads, in order of their paths."""
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    return _by_path(_reader(spark, {"recursiveFileLookup": "true", "pathGlobFilter": glob} | (options or {})).load(path))


def from_files(spark: SparkSession, paths: Sequence[str], options: dict[str, str] | None = None) -> DataFrame:
    """The images of a list, in its order. ``ignore_missing_keys`` skips paths that do not exist."""
    if len(set(paths)) != len(paths):
        raise ValueError("Duplicate filepaths found; each may be listed once")
    options = dict(options or {})
    skip = str(options.pop("ignore_missing_keys", "")).lower() == "true"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    full: list[tuple[str, int]] = []
    for i, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not skip or fs.exists(path):
            full.append((fs.makeQualified(path).toUri().toString(), i))
    if not full:
        return spark.createDataFrame([], f"image_id string, ord long, name string, image {IMAGE}")
    df = _reader(spark, options).load([p for p, _ in full])
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:///")  # noqa: E731  both spellings of a local path
    order = spark.createDataFrame(full, "path string, at long").withColumn("path", same(F.col("path")))
    return _by_path(df.join(order, same(F.col("image.origin")) == F.col("path")), F.col("at"))


def _is_image(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"height", "width", "nChannels", "data"} <= set(kind.names)


def _image_of(value: Column, kind: T.DataType) -> Column | None:
    """The image in a value of a type: an image struct, encoded bytes, a struct with ``bytes``, or the first of these in a struct."""
    if _is_image(kind):
        return _decoded(value)
    if isinstance(kind, T.BinaryType):
        return _decode(value)
    if isinstance(kind, T.StructType):
        if "bytes" in kind.names:
            return _decode(value["bytes"])
        for field in kind.fields:
            inner = _image_of(value[field.name], field.dataType)
            if inner is not None:
                return inner
    return None


#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROW_BITS = 33


def numbered(df: DataFrame, name: str = "image_id") -> DataFrame:
    """``df`` with ``name``: its rows counted from 0 in the order of its partitions.

    Rows of each partition are counted first, in a pass of its own; no row is moved
    and none leaves the JVM.  Where ``df`` has a shuffle, that pass reads its columns
    too, so that both passes deal the rows alike.
    """
    at = "__at"
    rows = df.withColumn(at, F.monotonically_increasing_id())
    size = F.count(F.lit(1)).alias("size")
    anchor = [F.max(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))] if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else []
    sizes = rows.groupBy(F.shiftright(at, _ROW_BITS).alias("__part")).agg(size, *anchor)
    before = F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")  # a row for each partition
    starts = sizes.select("__part", before.alias("__start"))
    out = rows.join(F.broadcast(starts), F.shiftright(at, _ROW_BITS) == F.col("__part"))
    return out.select((F.col("__start") + F.col(at).bitwiseAND((1 << _ROW_BITS) - 1)).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def from_frame(df: DataFrame, image_key: str = "image", id_column: str | None = None) -> DataFrame:
    """A table with an image column: Spark's image struct, encoded bytes, a struct with ``bytes``, or a pair such as (image, label).

    The id is ``id_column``, or the row's number in the order of the input's partitions.
    """
    if image_key not in df.columns:
        raise ValueError(f"image_key {image_key!r} is not a column; there are {df.columns}")
    image = _image_of(F.col(f"`{image_key}`"), df.schema[image_key].dataType)
    if image is None:
        raise ValueError(f"{image_key!r} holds no image but {df.schema[image_key].dataType.simpleString()}")
    if id_column is not None:
        rows = df.select(F.col(f"`{id_column}`").alias("image_id"), image.alias("image"))
    else:
        rows = numbered(df.select(image_key)).select("image_id", image.alias("image"))
    return rows.select("image_id", F.col("image_id").alias("ord"), F.concat(F.lit("idx: "), F.col("image_id").cast("string")).alias("name"), "image")


def _decode(raw: Column) -> Column:
    """Encoded bytes to an image struct; null where they cannot be decoded."""

    @F.pandas_udf(T._parse_datatype_string(IMAGE))
    def decoded(column: pd.Series) -> pd.DataFrame:
        names = ("origin", "height", "width", "nChannels", "mode", "data")
        rows = []
        for data in column:
            a = None if data is None else decode(bytes(data))
            if a is None:
                rows.append((None, -1, -1, -1, -1, None))
                continue
            a = a[:, :, None] if a.ndim == 2 else a[:, :, [2, 1, 0, *range(3, a.shape[2])]]
            h, w, c = a.shape
            rows.append(("", h, w, c, {1: 0, 3: 16, 4: 24}[c], a.tobytes()))
        return pd.DataFrame(rows, columns=names)

    return _decoded(decoded(raw))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Sorted paths of the images below ``path``."""
    return sorted(from_folder(spark, path).inputFiles())


def build(spark: SparkSession, data_path: str | None = None, filepaths: Sequence[str] | None = None, frame: DataFrame | None = None, image_key: str | None = None, id_column: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """The first source that is given: a folder, a list of paths, a table with its image column."""
    if data_path:
        return from_folder(spark, data_path, options)
    if filepaths:
        return from_files(spark, filepaths, options)
    if frame is not None and image_key:
        return from_frame(frame, image_key, id_column)
    raise ValueError("give data_path, filepaths, or frame with image_key")
