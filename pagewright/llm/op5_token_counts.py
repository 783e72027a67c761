"""Token counts by heap-and-linked-list byte-pair merging, without identifiers."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe
from pagewright.llm.common import table, whole_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs, repeated rows included.

    One pass without a shuffle: the distinct parts of a batch are matched once, the counts of their pre-tokens are remembered (a
    bounded number of them), and what isn't remembered is merged with a heap over a linked list. Null counts as empty: 0 bytes and 0
    tokens. A null id stays null. Other columns are not read, whatever their names. Texts of any length are counted
    whole; a run of n characters without a boundary takes n log n steps. Of adjacent pairs of equal rank (ties) the leftmost is merged first, as the
    library does. An empty table gives an empty result.
    """

    def work(batches):
        count = bpe.counter(vocabulary, public_tokenizers.PATTERN)
        for batch in (some for batch in batches for some in bpe.slices(batch, 1)):
            counts, ends = count(batch.column(1))
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            tokens = pa.array(np.diff(np.concatenate([[0], np.cumsum(counts)])[ends]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pa.compute.greater(tokens, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return ids.mapInArrow(work, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
