"""Session settings, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "readmill", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local session without it (tests) gets one of its own."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if not named.isDefined():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or os.path.join(tempfile.gettempdir(), "readmill-checkpoint"))
        named = sc._jsc.sc().getCheckpointDir()
    return named.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes wide rows as a compressed table in the shared folder and reads them back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def digest(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: together a 128-bit key for a long value."""
    return [F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(40503), *cols)]


def copy_number(key: str) -> Column:
    """Null for a row with an id; a number of its own for a row without, which cannot be told to be a copy."""
    return F.when(F.col(key).isNull(), F.monotonically_increasing_id())


def once_per_id(df: DataFrame, key: str = "read_id") -> DataFrame:
    """One row per id; a record delivered again is equal in the columns given here.

    Rows without an id are all kept.  The grouping combines on the map side (by sorting, as texts are no fixed-width state), so an id
    that is delivered very often stays cheap.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.withColumn("_copy", copy_number(key)).distinct().select(key)
    picked = df.withColumn("_copy", copy_number(key)).groupBy(key, "_copy").agg(F.first(F.struct(*rest)).alias("_v"))
    return picked.select(*[F.col(c) if c == key else F.col("_v")[c].alias(c) for c in df.columns])
