"""Operators that depend on the order of reads in a block or of bases in a read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readmill.functions.flat import flat


def runs(df: DataFrame, by: list[str], order: list[str], value: str, longest: int) -> DataFrame:
    """(by, run_no, piece_no, value, run_length, piece_length): runs of equal values, cut into pieces of `longest`."""
    w = W.partitionBy(*by).orderBy(*order)
    flagged = df.select(*by, *order, value).withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = flagged.withColumn("run_no", F.sum("_new").over(w))
    whole = numbered.groupBy(*by, "run_no").agg(F.first(value).alias(value), F.count("*").alias("run_length"))
    return whole.withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("run_length") / longest)))).withColumn(
        "piece_length", F.least(F.lit(longest).cast("long"), F.col("run_length") - (F.col("piece_no") - 1) * longest)
    )


def expand(pieces: DataFrame, by: list[str], value: str) -> DataFrame:
    """Inverse of runs: (by, ordinal, value)."""
    each = pieces.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("piece_length"))))
    w = W.partitionBy(*by).orderBy("run_no", "piece_no", "_i")
    return each.select(*by, F.row_number().over(w).alias("ordinal"), value)


def transitions(pieces: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, previous, value, n): how often a run of one value follows a run of another; the first has no previous."""
    w = W.partitionBy(*by).orderBy("run_no", "piece_no")
    return (
        pieces.withColumn("previous", F.lag(value).over(w)).groupBy(*by, "previous", value).agg(F.count("*").alias("n"))
    )


_BASES = np.frombuffer(b"ACGT", np.uint8)
_STATE = np.full(256, -1, np.int8)
_STATE[_BASES] = np.arange(4)


def _spread(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets, place of each byte's text start)."""
    codes, off = flat(col)
    return np.minimum(codes, 255).astype(np.uint8), off, np.repeat(off[:-1], np.diff(off))


def _decoded(col: pa.Array) -> pa.Array:
    data, off, head = _spread(col)
    at_start = np.arange(len(data)) == head
    value = np.where((data >= 48) & (data <= 51), data - 48, 0).astype(np.uint8)
    value[at_start] = np.maximum(_STATE[data[at_start]], 0)
    run = np.bitwise_xor.accumulate(value) if len(value) else value
    state = run ^ np.concatenate((np.zeros(1, np.uint8), run))[head]
    out = np.where(data == ord("."), ord("N"), _BASES[state]).astype(np.uint8)
    out[at_start] = data[at_start]
    return _texts(out, off, col)


def _encoded(col: pa.Array) -> pa.Array:
    data, off, head = _spread(col)
    place = np.arange(len(data))
    at_start = place == head
    state = _STATE[data]
    known = state >= 0
    # the last known base before each place of its text; its start counts as A if it is none
    last = np.maximum.accumulate(np.where(known | at_start, place, 0)) if len(place) else place
    before = np.maximum(state[np.concatenate(([0], last[:-1]))] if len(last) else state, 0)
    out = np.where(known, 48 + (before ^ state), ord(".")).astype(np.uint8)
    out[at_start] = data[at_start]
    return _texts(out, off, col)


def _texts(data: np.ndarray, off: np.ndarray, like: pa.Array) -> pa.Array:
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return pc.if_else(like.is_valid(), out, pa.scalar(None, pa.string())) if like.null_count else out


def _add_text(df: DataFrame, text_col: str, name: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, make(b.column(text_col))], names=[*b.schema.names, name])

    rest = [c for c in df.columns if c != name]
    return df.select(*rest).mapInArrow(run, T.StructType([*df.select(*rest).schema.fields, T.StructField(name, T.StringType())]))


def colours_to_bases(df: DataFrame, text_col: str) -> DataFrame:
    """Adds `bases`: a colour-space text decoded from its first base by a running XOR, all texts of a batch at once.

    With A0 C1 G2 T3 a colour is the XOR of two neighbouring bases; a dot decodes to N and keeps the state.
    """
    return _add_text(df, text_col, "bases", _decoded)


def bases_to_colours(df: DataFrame, text_col: str, out: str = "colours") -> DataFrame:
    """Inverse of colours_to_bases: the first base stays, N becomes a dot and keeps the state."""
    return _add_text(df, text_col, out, _encoded)


def _closed(budget: int):
    """Numbers the blocks of records that arrive in order: (by, read_id, rec_bytes) with `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, size = None, 0, 0
        for b in batches:
            keys = b.column(0).fill_null(-(1 << 63)).to_numpy()
            n = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.empty(len(n), np.int64)
            done = 0
            while done < len(n):
                if keys[done] != key:
                    key, part, size = keys[done], 0, 0
                end = int(np.searchsorted(keys, key, side="right"))  # keys are in order
                ends = size + np.cumsum(n[done:end])
                stop = done + int(np.searchsorted(ends, budget, side="right")) + 1  # with the record that exceeds the budget
                out[done:stop] = part
                part, size = (part + 1, 0) if stop <= end else (part, int(ends[-1]))
                done = min(stop, end)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "part"])

    return run


def assemble(df: DataFrame, budget: int, by: str) -> DataFrame:
    """(by, read_id, rec_bytes, part): the block a record goes to when a block is closed as soon as its bytes exceed the budget.

    Where a block ends depends on all blocks before it, so the records of one `by` value pass through one task in order, as a
    sorted stream of these three numbers; nothing of it is held but the current block's size.
    """
    kept = df.select(F.col(by).cast("long").alias(by), F.col("read_id").cast("long").alias("read_id"), F.col("rec_bytes").cast("long").alias("rec_bytes"))
    return kept.repartition(by).sortWithinPartitions(by, "read_id").mapInArrow(_closed(budget), f"{by} long, read_id long, rec_bytes long, part long")
