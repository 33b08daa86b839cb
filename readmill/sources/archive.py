"""Columnar block archive of reads: Parquet sorted by block, with a dataset sidecar and block checksums.

The streams of a block are column chunks of a row group; an archive keeps the settings, the dataset type and a
version in one sidecar row, and a checksum per block and stream that is verified on reading.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from readmill.functions import bases as B
from readmill.functions import tags as T
from readmill.operators import blocks
from readmill.plans.options import Options
from readmill.sources.fastq import file_system, files_of, qualified

VERSION = (1, 1)


#: Bytes of reads that a task sorts and cuts into blocks.
PART_BYTES = 256 << 20


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumn("_size", B.record_bytes(F.col("tag"), F.col("sequence"), F.col("plus"), F.col("quality")).cast("long"))


def assign_blocks(df: DataFrame, buffer_mb: int) -> DataFrame:
    """block_id by bytes: the reads of a range of read_ids are cut, in order, as soon as a block's size exceeds the buffer.

    Ranges are as many as the reads' bytes ask for; a range passes through its task as a sorted stream.
    """
    total = _sized(df).agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    budget, parts = buffer_mb << 20, max(1, -(-int(total) // max(PART_BYTES, buffer_mb << 20)))
    ranged = _sized(df).repartitionByRange(parts, "read_id").withColumn("_p", F.spark_partition_id().cast("long")).sortWithinPartitions("read_id")
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = size = 0
        for b in batches:
            n = b.column(names.index("_size")).fill_null(0).to_numpy()
            ids, first = np.empty(len(n), np.int64), b.column(names.index("_p"))[0].as_py() if len(b) else 0
            done = 0
            while done < len(n):
                ends = size + np.cumsum(n[done:])
                stop = done + int(np.searchsorted(ends, budget, side="right")) + 1
                ids[done:stop] = (first << 32) + part
                part, size = (part + 1, 0) if stop <= len(n) else (part, int(ends[-1]))
                done = stop
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids)], names=[*names, "block_id"])

    schema = T_.StructType([*ranged.schema.fields, T_.StructField("block_id", T_.LongType())])
    return ranged.mapInArrow(run, schema).drop("_size", "_p")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of records and checksums of each block, of reads that arrive block by block in order."""
    block, n, crc, out = None, 0, [0, 0, 0], []
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if keys[a] != block:
                if block is not None:
                    out.append((block, n, *crc))
                block, n, crc = keys[a], 0, [0, 0, 0]
            n += z - a
            crc = [zlib.crc32("".join(x or "" for x in b.column(k + 1).slice(a, z - a).to_pylist()).encode(), crc[k]) for k in range(3)]
    if block is not None:
        out.append((block, n, *crc))
    columns = list(zip(*out)) or [[]] * 5
    names = ["block_id", "n_records", "crc_tag", "crc_sequence", "crc_quality"]
    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=names)


def checksums(df: DataFrame, options: Options) -> DataFrame:
    """(block_id, n_records, crc of each stream) of the text in order; null for a stream that is not kept exactly.

    Blocks arrive sorted and are read as a stream, so that no block's text is held.
    """
    order = df.select("block_id", "tag", "sequence", "quality", "read_id").repartition("block_id").sortWithinPartitions("block_id", "read_id").drop("read_id")
    sums = order.mapInArrow(_crc, "block_id long, n_records long, crc_tag long, crc_sequence long, crc_quality long")
    kept = {"crc_tag": options.check_tag, "crc_sequence": options.crc32, "crc_quality": options.check_quality}
    return sums.select("block_id", "n_records", *((F.col(c) if k else F.lit(None).cast("long")).alias(c) for c, k in kept.items()))


def transform(df: DataFrame, options: Options, offset: int) -> DataFrame:
    """Title projection and lossy storage, as the settings say."""
    if options.fields:
        df = df.withColumn("tag", T.project(F.col("tag"), options.fields))
    if options.lossy:
        made = blocks.lossy_texts(df.withColumn("offset", F.lit(offset)), offset)
        df = made.drop("sequence", "quality", "offset").withColumnsRenamed({"lossy_sequence": "sequence", "lossy_quality": "quality"})
    return df


def write_archive(df: DataFrame, path: str, options: Options | None = None) -> None:
    """Writes reads (read_id, tag, sequence, plus, quality, and block_id if they have one).

    Fails for a dataset whose offset, colour space or plus lines are not consistent.
    """
    options = options or Options()
    if "block_id" not in df.columns:
        df = assign_blocks(df, options.buffer_mb)
    kind = blocks.dataset_type(df.withColumn("_all", F.lit(0)), "_all").first()
    if kind is None or not kind.usable and not (options.quality_offset and kind.consistent):
        raise ValueError("the reads are not one consistent dataset")
    offset = options.quality_offset or kind.quality_offset
    out = transform(df, options, offset).select("block_id", "read_id", "tag", "sequence", "quality", (F.length("plus") > 1).alias("repeated"))
    # cluster once by block; sorting inside a task keeps a block's reads together and in order
    out.repartitionByRange("block_id").sortWithinPartitions("block_id", "read_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/reads")
    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/reads")
    checksums(stored, options).write.mode("overwrite").parquet(f"{path}/blocks")
    n = spark.read.parquet(f"{path}/blocks").agg(F.count("*"), F.sum("n_records")).first()
    side = [(*VERSION, n[0], n[1], offset, bool(kind.plus_repetition), bool(kind.color_space), options.lossy, options.crc32, list(options.fields))]
    spark.createDataFrame(
        side, "major int, minor int, n_blocks long, n_records long, quality_offset int, plus_repetition boolean, color_space boolean, lossy boolean, crc32 boolean, fields array<int>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/dataset")


def dataset_of(spark: SparkSession, path: str):
    side = spark.read.parquet(f"{path}/dataset").first()
    if side is None or (side.major, side.minor) != VERSION:
        raise ValueError("not an archive of this version")
    seen = spark.read.parquet(f"{path}/blocks").agg(F.count("*"), F.coalesce(F.sum("n_records"), F.lit(0))).first()
    if tuple(seen) != (side.n_blocks, side.n_records):
        raise ValueError(f"the archive has {seen[0]} blocks with {seen[1]} records, its header says {side.n_blocks} with {side.n_records}")
    return side


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """block_id, read_id, tag, sequence, plus, quality; the plus line is made again from the title."""
    dataset_of(spark, path)
    df = spark.read.parquet(f"{path}/reads")
    return df.select("block_id", "read_id", "tag", "sequence", B.plus_line(F.col("tag"), F.col("repeated")).alias("plus"), "quality")


#: Columns of the stored reads that make up each stream of an archive.
STREAMS = {"meta": ("block_id", "read_id", "repeated"), "tag": ("tag",), "dna": ("sequence",), "quality": ("quality",)}


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = {c: k for k, cols in STREAMS.items() for c in cols}
    for b in batches:
        names, raw, stored = [], [], []
        for path in b.column(0).to_pylist():
            system, at = file_system(path)
            with system.open_input_file(at) as f:
                meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        col = meta.row_group(g).column(c)
                        names.append(of.get(col.path_in_schema, "meta"))
                        raw.append(col.total_uncompressed_size)
                        stored.append(col.total_compressed_size)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(raw, pa.int64()), pa.array(stored, pa.int64())], names=["stream", "r", "s"])


def stream_report(spark: SparkSession, path: str) -> DataFrame:
    """(stream, encoded_bytes, stored_bytes) of an archive's four streams, from the footers of its files, which tasks read."""
    paths = [p for p, _ in files_of(qualified(spark, f"{path}/reads")) if p.endswith(".parquet")]
    files = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}))
    return files.mapInArrow(_footers, "stream string, r long, s long").groupBy("stream").agg(F.sum("r").alias("encoded_bytes"), F.sum("s").alias("stored_bytes"))


def corrupt_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks whose reads no longer have the checksums or the number that were stored."""
    side = dataset_of(spark, path)
    options = Options(lossy=side.lossy, crc32=side.crc32, fields=tuple(side.fields))
    now = checksums(spark.read.parquet(f"{path}/reads"), options)
    then = spark.read.parquet(f"{path}/blocks")
    names = ("n_records", "crc_tag", "crc_sequence", "crc_quality")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return (
        then.alias("a").join(now.alias("b"), F.col("a.block_id") == F.col("b.block_id"), "full")
        .filter(~same).select(F.coalesce("a.block_id", "b.block_id").alias("block_id"))
    )
