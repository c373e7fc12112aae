"""Intermediate tables in the shared folder, so that later plans know their size and lost executors cost nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.runtime import scratch_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
