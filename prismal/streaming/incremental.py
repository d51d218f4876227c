"""Structured Streaming: properties and scores of images as they arrive.

What depends on one image alone is a stateless projection of the stream.  What
depends on the whole dataset (odd sizes, duplicates) is an audit over the properties
that the stream has stored: ``store_properties`` writes them batch by batch, and
``ImageAudit.of_properties`` scores all of them, old and new, without decoding again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import kernels, scores
from ..operators import properties
from ..schema import EXTENSIONS, IMAGE, PROPERTY, flag_column, merged_params, score_column


def image_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New images below ``path`` in the batch sources' row type, decoded from the files' bytes."""
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    from ..sources.images import _decode

    return files.select(F.col("path").alias("image_id"), F.col("path").alias("ord"), F.element_at(F.split("path", "/"), -1).alias("name"), _decode(F.col("content")).alias("image"))


def property_stream(images: DataFrame, wanted: Sequence[str], hashes: Sequence[tuple[str, int | None]] = ()) -> DataFrame:
    """The batch pass over a stream (or a batch) of images."""
    return properties.compute(images, wanted, hashes)


def score_stream(images: DataFrame, issue_types: dict[str, dict] | None = None) -> DataFrame:
    """Scores and flags of the issue types that one image decides."""
    single = [t for t in PROPERTY if t != "odd_size"]
    request = issue_types or {t: {} for t in single}
    wrong = [t for t in request if t not in single]
    if wrong:
        raise ValueError(f"{wrong} need the whole dataset")
    df = property_stream(images, list(dict.fromkeys(PROPERTY[t] for t in request)))
    out: list = ["image_id", "name"]
    for t, given in request.items():
        p = merged_params(t, given)
        score = scores.SCORES[t](p)
        out += [score.alias(score_column(t)), scores.flag(score, p.get("threshold", 0.5)).alias(flag_column(t))]
    return df.select(*out)


def store_properties(images: DataFrame, path: str, checkpoint: str, hashes: Sequence[tuple[str, int | None]] = (("md5", None), ("phash", 8))) -> StreamingQuery:
    """Start writing every property and hash of the images of a stream to Parquet; a batch that is run again is written once."""
    found = property_stream(images, list(dict.fromkeys(PROPERTY.values())), hashes)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


__all__ = ["store_properties", "IMAGE", "image_stream", "kernels", "property_stream", "score_stream"]
