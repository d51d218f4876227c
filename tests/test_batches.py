from __future__ import annotations

import pyarrow as pa

from prismal.operators import properties
from prismal.plans import raster_queries


def test_batches_of_images_are_bounded(spark, tmp_path):
    """However many images a partition has, a worker is handed some MB of them at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    spark.range(2000).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    images = raster_queries.color_rasters(spark, str(tmp_path)).coalesce(1)
    out = properties.compute(images, ["entropy"])

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    got = images.select("image_id", "image.data").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == out.where("entropy > 0").count() == 2000
    assert max(r["bytes"] for r in got) < 2 * properties.BATCH_BYTES
    spark.conf.set(key, "1m")
    properties.compute(images, ["entropy"])
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
