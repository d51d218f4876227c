"""One pass over the images that gives every property and hash asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scores import aspect_ratio, color_space, size
from ..schema import COLUMNS

#: Properties that need no pixels, as Column expressions.
_GEOMETRY = {
    "aspect_ratio": lambda: aspect_ratio(F.col("image.width"), F.col("image.height")),
    "color_space": lambda: color_space(F.col("image.nChannels")),
    "size": lambda: size(F.col("image.width"), F.col("image.height")),
}
_PIXELS = ("brightness", "entropy", "blurriness")
#: About the bytes of pixels that are handed to a worker at once.
BATCH_BYTES = 8 << 20


def hash_column(kind: str, hash_size: int | None) -> str:
    return kind if hash_size is None else f"{kind}_{hash_size}"


def compute(images: DataFrame, properties: Sequence[str] = (), hashes: Sequence[tuple[str, int | None]] = (), own: dict[str, Callable[[np.ndarray], float | None]] | None = None) -> DataFrame:
    """image_id, ord, name, then the columns of ``properties``, of ``own`` and one for each of ``hashes``.

    ``own`` has functions of an image's pixels by the name of the column they fill.

    Each image is read and decoded once however much is asked for.  Geometry and md5
    are expressions; only what needs pixel arithmetic goes through numpy, in Arrow
    batches that never hold more than one decoded image beside the batch.  Null images
    give nulls.
    """
    pixel = [p for p in _PIXELS if p in properties]
    perceptual = [(k, n) for k, n in hashes if k != "md5"]
    keep = [F.col(c) for c in ("image_id", "ord", "name")]
    easy = [_GEOMETRY[p]().alias(p) for p in _GEOMETRY if p in properties]
    if any(k == "md5" for k, _ in hashes):
        easy.append(F.md5("image.data").alias("md5"))
    own = own or {}
    if not pixel and not perceptual and not own:
        return images.select(*keep, *easy)
    head = images.select(*keep, *easy, F.col("image.height").alias("__h"), F.col("image.width").alias("__w"), F.col("image.nChannels").alias("__c"), F.col("image.data").alias("__d"))
    columns = [c for p in pixel for c in COLUMNS[p]] + list(own)
    names = [hash_column(k, n) for k, n in perceptual]
    kept = [f for f in head.schema.fields if not f.name.startswith("__")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [None] * b.num_rows for c in columns + names}
            raw = [b.column(b.schema.get_field_index(c)) for c in ("__h", "__w", "__c", "__d")]
            for i in range(b.num_rows):
                h, w, c, data = (x[i].as_py() for x in raw)
                if not h or not w or data is None or len(data) != h * w * c:
                    continue
                image = kernels.pixels(h, w, c, data)
                if "brightness" in pixel:
                    for k, v in kernels.brightness(image).items():
                        out[k][i] = v
                if "entropy" in pixel:
                    out["entropy"][i] = kernels.entropy(image)
                if "blurriness" in pixel:
                    for k, v in kernels.blurriness(image).items():
                        out[k][i] = v
                for name, kernel in own.items():
                    value = kernel(image)
                    out[name][i] = None if value is None else float(value)
                for (kind, n), name in zip(perceptual, names, strict=True):
                    out[name][i] = kernels.HASHES[kind](image, n)
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(out[c], pa.float64()) for c in columns] + [pa.array(out[c], pa.string()) for c in names]
            yield pa.record_batch(arrays, names=[f.name for f in kept] + columns + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` double" for c in columns] + [f"`{c}` string" for c in names])
    # Spark counts rows of a batch unless told otherwise, and 10,000 images are many bytes.
    spark, key = images.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return head.mapInArrow(run, schema)
