"""File readers: CSV, compressed JSON lines, document directories, inventories (S1-S9)."""

from __future__ import annotations

import hashlib
import lzma
from collections.abc import Sequence

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import safe_number


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """CSV with header and a declared column order; numeric columns that do not parse become NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    return raw.select(*[safe_number(F.col(c)).alias(c) if c in numeric else F.col(c) for c in columns])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or in a codec Spark knows (gz, bz2, zst); blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_xz_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in xz files, one task per file: the archive is decoded as a stream, line by line."""
    listing = spark.read.format("binaryFile").load(path).select("path")

    def lines(batches):
        import pandas as pd

        for pdf in batches:
            for name in pdf["path"]:
                system, inner = pyarrow.fs.FileSystem.from_uri(name)
                held = []
                with system.open_input_stream(inner, compression=None) as raw, lzma.open(raw, "rt", encoding="utf-8") as text:
                    for line in text:
                        if line.strip():
                            held.append(line)
                        if len(held) == 4096:
                            yield pd.DataFrame({"line": held})
                            held = []
                if held:
                    yield pd.DataFrame({"line": held})

    spread = listing.repartition("path")
    return spread.mapInPandas(lines, "line string").select(F.from_json("line", schema).alias("r")).select("r.*")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file with its path; `corrupt` marks texts that do not parse."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return raw.withColumn("corrupt", F.try_parse_json("body").isNull())


def read_with_source(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of parquet folders with the folder name as `source_file`."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.parquet(*paths).select("*", folder.alias("source_file"))


def file_inventory(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """Path, byte count and SHA-256 of every file; contents are hashed block by block inside tasks."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
               .select("path", F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -1).alias("file")))
    if not digest:
        return listing

    def hashed(batches):
        for pdf in batches:
            sums = []
            for name in pdf["path"]:
                system, inner = pyarrow.fs.FileSystem.from_uri(name)
                h = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as raw:
                    while block := raw.read(1 << 20):
                        h.update(block)
                sums.append(h.hexdigest())
            yield pdf.assign(sha256=sums)

    return listing.repartition("path").mapInPandas(hashed, "path string, bytes long, file string, sha256 string")


def dataset_status(spark: SparkSession, patterns: Sequence[tuple[str, str]], files: DataFrame) -> DataFrame:
    """Per (dataset, pattern): files matching, bytes, formats and whether any is present."""
    known = F.array(*[F.struct(F.lit(d).alias("dataset"), F.lit(p).alias("pattern")) for d, p in patterns])
    kind = F.element_at(F.split("file", "\\."), -1)
    hits = files.select("bytes", kind.alias("kind"), F.explode(
        F.filter(known, lambda k: F.regexp_like(F.col("file"), k["pattern"]))).alias("k"))
    found = hits.groupBy("k.dataset", "k.pattern").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
                                                       F.concat_ws(";", F.array_sort(F.collect_set("kind"))).alias("format"))
    wanted = spark.createDataFrame(list(patterns), "dataset string, pattern string")
    return wanted.join(found, ["dataset", "pattern"], "left").select(
        "dataset", "pattern", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("format", F.lit("")).alias("format"), F.when(F.col("files") > 0, "present").otherwise("missing").alias("status"))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names only."""
    return spark.read.parquet(path).columns
