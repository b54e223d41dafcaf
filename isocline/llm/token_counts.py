"""Token counts of whole texts: pre-tokens proven to be one token count directly, only the rest is merged."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import slices


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row, for a byte-level tokenizers file.

    Counts are those of the library, without added special tokens. Null and empty texts have 0 bytes and tokens; repeated
    rows and null ids are kept as they come; an empty table gives an empty result; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = vocab.counter(tokenizer)
        for batch in slices(batches):
            texts = pc.fill_null(batch.column(1), "")
            counts = [counter.count(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
