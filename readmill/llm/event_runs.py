"""Repeated consecutive events: events become symbols of a string, runs are backreference matches.

The events of all entities of an Arrow batch are written as one string, one code point per canonical event,
with a separator between entities, so that a single regular expression finds the runs of the whole batch.
Spans are mapped back to entity and position (here the position takes the place of a time).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions.flat import flat
from readmill.plans.runtime import copy_number

#: Stands between entities; not a symbol of either alphabet.
WALL = 0


def repeats(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest stretch of one symbol other than WALL, at least `least` long."""
    text = symbols.astype("<u4").tobytes().decode("utf-32-le")
    found = [m.span() for m in re.finditer(rf"([^\x00])\1{{{least - 1},}}", text)]
    spans = np.array(found, np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def fill_from_left(codes: np.ndarray, off: np.ndarray, wild: np.ndarray) -> np.ndarray:
    """Every wild position takes the symbol before it; at the start of an entity it stands for itself."""
    take = np.arange(len(codes))
    fixed = ~wild
    fixed[off[:-1][np.diff(off) > 0]] = True
    return codes[np.maximum.accumulate(np.where(fixed, take, 0))]


def equal_runs(codes: np.ndarray, off: np.ndarray, least: int, wild: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols per entity, wild symbols counting as the one before."""
    filled = fill_from_left(codes, off, np.isin(codes, np.array(wild, codes.dtype)))
    # a wall before every entity; code points are moved up by one so that none is the wall
    entity = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(codes)) + entity + 1
    line = np.zeros(len(codes) + len(off), np.uint32)
    line[at] = filled.astype(np.uint32) + 1
    line[line >= 0xD800] += 0x800  # not a surrogate
    a, b = repeats(line, least)
    shift = np.searchsorted(at, a)
    return shift, shift + (b - a)


def near_runs(codes: np.ndarray, off: np.ndarray, least: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs in which each value differs by at most `step` from the one before.

    The symbol of a position says whether it continues its predecessor, so a run of n values is a
    repetition of n - 1 such symbols.
    """
    v = codes.astype(np.int64)
    line = np.zeros(len(v), np.uint32)
    line[1:] = np.abs(np.diff(v)) <= step
    line[off[:-1][np.diff(off) > 0]] = WALL
    a, b = repeats(line, least - 1)
    return a - 1, b


def _run(least_equal: int, least_near: int, step: int, wild: str):
    marks = tuple(map(ord, wild))

    def out(ids, name, codes, off, a, b):
        entity = np.searchsorted(off, a, side="right") - 1
        same = np.zeros(len(a), np.int64)
        if len(a):
            long = np.repeat(a, b - a)
            i = long + (np.arange(len(long)) - np.repeat(np.cumsum(b - a) - (b - a), b - a))
            same = np.add.reduceat((codes[i] == codes[long]).astype(np.int64), np.cumsum(b - a) - (b - a))
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(entity)),
                pa.array([name] * len(a), pa.string()),
                pa.array((a - off[entity] + 1).astype(np.int32)),
                pa.array(same.astype(np.int32)),
                pa.array((b - a).astype(np.int32)),
            ],
            names=["id", "field_name", "start_pos", "n_same", "span"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, off = flat(b.column(1))
            yield out(b.column(0), "sequence", codes, off, *equal_runs(codes, off, least_equal, marks))
            codes, off = flat(b.column(2))
            yield out(b.column(0), "quality", codes, off, *near_runs(codes, off, least_near, step))

    return run


def event_runs(
    df: DataFrame,
    id_col: str,
    sequence_col: str,
    quality_col: str,
    least_equal: int = 8,
    least_near: int = 12,
    step: int = 1,
    wild: str = "N.",
) -> DataFrame:
    """(id, field_name, start_pos, n_same, span): one row per long run of a record.

    field_name `sequence`: longest stretches of one symbol of at least `least_equal` positions, where wild
    symbols count as the symbol before them (at the start as themselves).  field_name `quality`: longest
    stretches of at least `least_near` characters in which each code differs by at most `step` from the one
    before, where the sequence is not null and as long as the quality.  n_same counts the positions that hold
    the first symbol of the stretch.  A null or empty text has no runs; a null id is kept as null; rows that
    repeat an id count once; other columns are ignored.
    """
    src = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(sequence_col).alias("s"),
        F.when(F.length(sequence_col) == F.length(quality_col), F.col(quality_col)).alias("q"),
    )
    runs = src.mapInArrow(
        _run(least_equal, least_near, step, wild), "id long, field_name string, start_pos int, n_same int, span int"
    )
    # a re-delivered record gives the same runs; only runs are exchanged, not texts
    return (
        runs.withColumn("_copy", copy_number("id"))
        .groupBy("id", "_copy", "field_name", "start_pos")
        .agg(F.first("n_same").alias("n_same"), F.first("span").alias("span"))
        .drop("_copy")
    )
