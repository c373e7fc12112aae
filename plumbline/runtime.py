"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; a private one only when running locally without a setting."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder so later stages see one fixed placement of rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str = "state") -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back.

    A checkpoint keeps what the optimizer knew of the plan it came from; in a loop that builds each pass on the last, that
    knowledge grows without end. A table read back knows its size and schema only.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even rows over the cores when a scan has fewer splits than cores; for frames with heavy work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise_evenly(df: DataFrame) -> DataFrame:
    """Write a frame that later passes expand row by row, with at least one partition per core."""
    return materialise(df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def explode_numbers(values: Sequence[float]) -> Column:
    """One row per number, written as a single SQL expression so that long grids build quickly."""
    return F.expr("explode(array(" + ", ".join(f"{float(v)!r}D" for v in values) + "))")


def with_row(df: DataFrame, one_row: DataFrame, prefix: str = "") -> DataFrame:
    """Attach the columns of a one-row frame to every row through one scalar subquery."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("s")).scalar()
    wide = df.withColumn("_row", packed)
    return wide.select(*df.columns, *[F.col("_row")[n].alias(prefix + n) for n in names])


def small_frame(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """A driver-sized table as a local relation."""
    return spark.createDataFrame(pa.table({n: pa.array(list(v)) for n, v in columns.items()}))
