"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import pick

TOKEN_LIMIT = 1024


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Counts are those of the BPE file at ``path`` without begin or end tokens;
    special strings in a text count as one token, as the library does by default.
    A null or empty text has 0 bytes and 0 tokens; a null doc_id is kept; repeated
    rows each give a row; an empty table gives none; other columns are not read.
    One narrow pass without a shuffle: memory holds one batch and a bounded memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe.counter(path).count
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.record_batch(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([0 if t is None else len(t.encode()) for t in texts], pa.int64()),
                    pa.array(list(map(count, texts)), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    out = pick(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
