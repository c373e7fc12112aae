"""Result sinks (S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, form: str = "parquet", evidence_level: str | None = None) -> None:
    """Write as parquet, csv, csv.gz or json; `evidence_level` is added as a literal column."""
    if evidence_level:
        df = df.withColumn("evidence_level", F.lit(evidence_level))
    out = df.write.mode("overwrite")
    if form == "parquet":
        out.parquet(path)
    elif form in ("csv", "csv.gz"):
        out.option("header", True).option("compression", "gzip" if form.endswith("gz") else "none").csv(path)
    elif form == "json":
        out.json(path)
    else:
        raise ValueError(f"unknown form: {form}")
