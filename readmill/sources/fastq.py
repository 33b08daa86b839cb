"""FASTQ text as a splittable Spark data source, and chunks of text held in a table."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readmill.functions.flat import ranges
from readmill.functions.tags import project

SCHEMA = "file_no int, start_byte long, tag string, sequence string, plus string, quality string, valid boolean"
#: Bytes before and behind a split that are read first to find a record's start and end; more if they do not suffice.
PEEK = 1 << 16
#: Bytes before or behind a split without a record's start from which on the text is taken for something else.
MOST_PEEK = 1 << 30
BATCH = 20_000


class ByteRange(InputPartition):
    def __init__(self, file_no: int, path: str, start: int, stop: int, size: int):
        self.file_no, self.path, self.start, self.stop, self.size = file_no, path, start, stop, size


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path (any that Arrow knows by its scheme) and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder, or of those that a pattern matches."""
    system, base = file_system(path)
    head = path[: len(path) - len(base)] if path.endswith(base) else "file://" if path.startswith("file:") else ""
    if any(c in base for c in "*?["):
        fixed = base[: min(base.index(c) for c in "*?[" if c in base)].rpartition("/")[0]
        found = [i for i in system.get_file_info(pafs.FileSelector(fixed, recursive=True)) if fnmatch.fnmatch(i.path, base)]
    else:
        info = system.get_file_info(base)
        found = system.get_file_info(pafs.FileSelector(base)) if info.type == pafs.FileType.Directory else [info]
    return sorted(
        (head + i.path, i.size) for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))
    )


class Lines:
    """The lines of a buffer and what the record rules ask of them."""

    def __init__(self, buf: bytes, ended: bool):
        self.data = data = np.frombuffer(buf, np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate(([0], ends + 1))
        if ended and starts[-1] < len(data):
            ends = np.append(ends, len(data))
        self.start = starts[: len(ends)]
        #: where the line behind each line begins
        self.behind = np.append(starts, len(data))[1 : len(ends) + 1]
        self.end = ends - ((ends > self.start) & (data[np.maximum(ends - 1, 0)] == 13))
        self.size = self.end - self.start
        first = np.where(self.size > 0, data[np.minimum(self.start, max(len(data) - 1, 0))], 0) if len(ends) else np.zeros(0, np.uint8)
        self.title = first == ord("@")
        n = len(ends)
        plus = first == ord("+")
        #: a line from which on a record begins beyond doubt: a sequence never begins like a title
        self.likely = np.zeros(n, bool)
        self.likely[: max(n - 2, 0)] = self.title[: n - 2] & ~self.title[1 : n - 1] & plus[2:] if n > 2 else False
        certain = self.likely[: max(n - 3, 0)] & (self.size[1 : n - 2] == self.size[3:]) if n > 3 else np.zeros(0, bool)
        self.certain = np.flatnonzero(certain)

    def valid(self, at: np.ndarray) -> np.ndarray:
        return self.title[at] & (self.size[at + 2] > 0) & (self.size[at + 1] == self.size[at + 3])


def scan(lines: Lines, at: int, ended: bool) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """(first lines of the valid records from line `at` on, (first line, line behind) of what is none, line where the text ends too early).

    After a record that breaks a rule the scan goes on at the next line from which on a record begins beyond doubt.
    """
    n = len(lines.start)
    good, bad = [], []
    while at < n:
        k = at + 4 * np.arange(min((n - at) // 4, 4096))
        ok = lines.valid(k)
        stop = len(k) if ok.all() else int(np.argmin(ok))
        good.append(k[:stop])
        at += 4 * stop
        if stop == len(k) and len(k) and n - at >= 4:
            continue
        if n - at < 4 and not ended:
            break
        if at >= n:
            break
        later = np.searchsorted(lines.certain, at, side="right")
        if later == len(lines.certain) and not ended:
            break
        to = int(lines.certain[later]) if later < len(lines.certain) else n
        cuts = [at, *(at + 1 + np.flatnonzero(lines.likely[at + 1 : to])).tolist(), to]
        bad += zip(cuts[:-1], cuts[1:])
        at = to
    return np.concatenate(good) if good else np.zeros(0, np.int64), bad, at


def _text(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    raw = data[ranges(start, size)]
    if len(raw) and raw.max() >= 128:
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())], pa.string())
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(raw.astype(np.uint8)))


def _batch(part: ByteRange, start: np.ndarray, texts: list[pa.Array], valid: bool) -> pa.RecordBatch:
    n = len(start)
    head = [pa.array(np.full(n, part.file_no, np.int32)), pa.array(start.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*head, *texts, pa.array(np.full(n, valid))], names=[c.split()[0] for c in SCHEMA.split(", ")])


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """The records, and what is none, that begin in a byte range."""
    system, path = file_system(part.path)
    back = ahead = PEEK
    with system.open_input_file(path) as f:
        while True:
            if max(back, ahead) > MOST_PEEK:
                raise ValueError(f"no record begins within {MOST_PEEK} bytes of byte {part.start} of {part.path}")
            low, high = max(0, part.start - back), min(part.size, part.stop + ahead)
            f.seek(low)
            lines = Lines(f.read(high - low), high == part.size)
            # a scan that begins a little before the split is in step with one from the file's start
            at = 0
            if low:
                # the first lines are cut off or may be a quality whose record is not in sight
                sure = lines.certain[lines.certain > 3]
                sure = sure[~lines.likely[sure - 3]]
                if not len(sure) or low + lines.start[sure[0]] >= part.start:
                    back *= 4
                    continue
                at = int(sure[0])
            good, bad, stopped = scan(lines, at, high == part.size)
            if high < part.size and (stopped >= len(lines.start) or low + lines.start[stopped] < part.stop):
                ahead *= 4
                continue
            break
    begin = low + lines.start
    good = good[(begin[good] >= part.start) & (begin[good] < part.stop)]
    for a in range(0, len(good), BATCH):
        k = good[a : a + BATCH]
        yield _batch(part, begin[k], [_text(lines.data, lines.start[k + i], lines.end[k + i]) for i in range(4)], True)
    bad = [(a, b) for a, b in bad if part.start <= begin[a] < part.stop and lines.size[a:b].any()]
    if bad:
        line = lambda k: lines.data[lines.start[k] : lines.end[k]].tobytes().decode("utf-8", "replace")
        texts = [pa.array([line(a + i) if a + i < b else None for a, b in bad], pa.string()) for i in range(4)]
        yield _batch(part, begin[[a for a, _ in bad]], texts, False)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.split = int(options.get("splitBytes", 64 << 20))
        self.files = sorted(f for p in options.get("path", "").split(",") for f in files_of(p))

    def partitions(self) -> list[ByteRange]:
        return [
            ByteRange(k, p, a, min(a + self.split, size), size)
            for k, (p, size) in enumerate(self.files)
            for a in range(0, size, self.split)
        ]

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is not None:  # there is a file
            yield from read_range(part)


class FastqDataSource(DataSource):
    """`spark.read.format("fastq").option("splitBytes", n).load(path)`: a file, a folder or a pattern, on any file system Arrow knows.

    Every split finds its first record itself, so any split count gives the same rows.  CR is dropped, a last
    record without a line end is kept.  Text that is no record comes out with valid = false, its first four lines in the
    columns (null where it has fewer), and does not touch the records behind it; blank lines between records are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqDataSource)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the cluster's default file system where it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 64 << 20, fields: tuple[int, ...] = ()) -> DataFrame:
    """Reads of FASTQ files, with a read_id that follows the order of files and records; of titles only `fields` if given."""
    register(spark)
    paths = ",".join(qualified(spark, p) for p in path.split(","))
    df = spark.read.format("fastq").option("splitBytes", split_bytes).load(paths)
    if fields:
        df = df.withColumn("tag", project(F.col("tag"), fields))
    # a byte offset orders the records of a file; 2**48 bytes a file are enough
    return df.withColumn("read_id", F.col("file_no").cast("long") * (1 << 48) + F.col("start_byte"))


def _ranges_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start, stop, size in zip(*(c.to_pylist() for c in b.columns)):
            for rows in read_range(ByteRange(0, path, start, stop, size)):
                names = pa.array([path] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([names, *rows.columns[1:]], names=["path", *rows.schema.names[1:]])


def records_of(files: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """The rows of the `fastq` source, with path in place of file_no, for a frame of (path, length), a stream of files as well.

    Files are cut into byte ranges that are read by different tasks, so no file has to fit in one row.
    """
    cut = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges_ = cut.select("path", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("stop"), "length")
    return ranges_.repartition("path", "start").mapInArrow(_ranges_read, SCHEMA.replace("file_no int", "path string"))


def write_fastq(df: DataFrame, path: str) -> None:
    """Writes tag, sequence, plus, quality as FASTQ text in the order of read_id."""
    from readmill.functions.bases import fastq_text

    df.repartitionByRange("read_id").sortWithinPartitions("read_id").select(
        fastq_text(F.col("tag"), F.col("sequence"), F.col("plus"), F.col("quality")).alias("value")
    ).write.mode("overwrite").text(path)


def chunk_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, record_no, tag, sequence, plus, quality, valid) of the records in chunks of FASTQ text.

    A chunk starts at a record; CR and a missing last line end do not matter; lines beyond the last full
    record are not a record.
    """
    text = F.rtrim(F.regexp_replace(text_col, "\r\n", "\n"), F.lit("\n"))
    lines = df.select(id_col, F.split(text, "\n").alias("x"))
    n = F.floor(F.size("x") / 4)
    each = lines.filter(F.size("x") >= 4).select(id_col, "x", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("record_no"))
    line = lambda k: F.element_at("x", (F.col("record_no") * 4 - 3 + k).cast("int"))
    out = each.select(id_col, "record_no", *(line(k).alias(c) for k, c in enumerate(("tag", "sequence", "plus", "quality"))))
    ok = F.col("tag").startswith("@") & (F.length("plus") > 0) & (F.length("sequence") == F.length("quality"))
    return out.withColumn("valid", ok)
