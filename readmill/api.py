"""Functions on paths and iteration over records, for use without the DataFrame API."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from readmill.functions.bases import fastq_text
from readmill.plans.options import Options
from readmill.plans.runtime import new_folder
from readmill.sources.archive import corrupt_blocks, read_archive, write_archive
from readmill.sources.fastq import read_fastq, write_fastq


class Record(NamedTuple):
    tag: str
    sequence: str
    plus: str
    quality: str


class RecordWriter:
    """Writes an archive record by record: `with RecordWriter(spark, path) as w: w.write(Record(...))`.

    Records are held up to the buffer of the options and then stored in the shared folder; the archive is written at the end.
    Nothing is written if the block is left by an error.
    """

    def __init__(self, spark: SparkSession, target: str, options: Options | None = None):
        self.spark, self.target, self.options = spark, target, options or Options()
        self.at = new_folder(spark, "records")
        self.rows: list[Record] = []
        self.n = self.held = 0

    def write(self, record: Record) -> None:
        self.rows.append(record)
        self.held += sum(map(len, record)) + 4
        if self.held > self.options.buffer_mb << 20:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            columns = {k: pa.array([getattr(r, k) for r in self.rows], pa.string()) for k in Record._fields}
            table = pa.table({"read_id": pa.array(range(self.n, self.n + len(self.rows)), pa.int64())} | columns)
            self.spark.createDataFrame(table).write.mode("append").parquet(self.at)
            self.n, self.rows, self.held = self.n + len(self.rows), [], 0

    def finish(self) -> None:
        self.flush()
        if not self.n:
            raise ValueError("there are no records")
        write_archive(self.spark.read.parquet(self.at), self.target, self.options)

    def __enter__(self) -> RecordWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.finish()


def compress(spark: SparkSession, source: str, target: str, options: Options | None = None) -> None:
    """FASTQ text to an archive; malformed records are an error."""
    reads = read_fastq(spark, source)
    bad = reads.filter(~F.col("valid")).limit(1).collect()
    if bad:
        raise ValueError(f"malformed record at byte {bad[0].start_byte} of file {bad[0].file_no}")
    write_archive(reads, target, options)


def decompress(spark: SparkSession, source: str, target: str) -> None:
    """An archive to FASTQ text, after its checksums were verified."""
    bad = corrupt_blocks(spark, source).count()
    if bad:
        raise ValueError(f"{bad} blocks are corrupt")
    write_fastq(read_archive(spark, source), target)


def records(spark: SparkSession, path: str, archive: bool = False, skip_damaged: bool = False) -> Iterator[Record]:
    """The records of an archive or of FASTQ text in order, one partition at a time; text that is no record is an error unless it is to be skipped."""
    df = read_archive(spark, path).withColumn("valid", F.lit(True)) if archive else read_fastq(spark, path)
    for r in df.orderBy("read_id").select("tag", "sequence", "plus", "quality", "valid").toLocalIterator():
        if r.valid:
            yield Record(*r[:4])
        elif not skip_damaged:
            raise ValueError(f"damaged record {r.tag!r}")


def lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The FASTQ text of an archive, record by record."""
    df = read_archive(spark, path).orderBy("read_id")
    for r in df.select(fastq_text(F.col("tag"), F.col("sequence"), F.col("plus"), F.col("quality"))).toLocalIterator():
        yield r[0]
