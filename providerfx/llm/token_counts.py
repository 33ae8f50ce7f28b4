"""Token counts: Arrow functions that return lengths only, over byte-balanced ranges of each batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.llm import blocks as B
from providerfx.llm.tokens import encoder


def count_udf(tokenizer: str):
    @F.arrow_udf("long")
    def n_tokens(text: pa.Array) -> pa.Array:
        return pa.array(encoder(tokenizer).counts(text))

    return n_tokens


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); no shuffle, one pass.

    A null text counts as empty: 0 bytes, 0 tokens. Columns of df with one of the three names are replaced,
    all others, repeated rows included, stay as they are; an empty df gives an empty result.
    """
    B.small_batches(df.sparkSession)
    col = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = df.withColumns({"n_bytes": F.octet_length(col).cast("long"), "n_tokens": count_udf(tokenizer)(col)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
