"""Frames that several later steps read, written once to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Reliable lineage cut: written once as a Parquet table below the shared
    ``spark.checkpoint.dir`` and read back (columnar, survives executor loss;
    cheaper than an RDD checkpoint of serialised rows).  ``session.temporary``
    removes it."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
