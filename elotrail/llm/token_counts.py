"""Operator 1: token counts by Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .encoding import Encoder


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of ``text`` (not null) by the tokenizer file at ``tokenizer``, without
    begin, end or added special tokens; special strings inside a text count as the
    library's default has them.  The file must be readable at that path on executors."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder.of(tokenizer)
        for a in batches:
            yield pa.array([len(b) // 4 for b in enc.encode(a.to_pylist())], pa.int64())

    return count(text)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024,
                 text: str = "text") -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One narrow pass without a shuffle, rows as they come (repeated rows stay).  A
    null or empty text has 0 bytes and 0 tokens; an empty table gives no rows;
    columns of these three names are replaced.  Long texts are split at safe
    boundaries, so memory follows the largest text, not the table."""
    return (docs.withColumn("n_bytes", F.octet_length(text_of(text)).cast("long"))
            .withColumn("n_tokens", token_count(text_of(text), tokenizer))
            .withColumn("over_limit", F.col("n_tokens") > limit))
