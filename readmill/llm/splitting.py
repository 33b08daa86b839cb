"""Splitting oversized chunks of four-line records at record boundaries.

Two ways to place the cuts:

* `greedy` (used where a piece must hold as many whole records as fit),
* `balanced`: the least number of pieces, equal-length targets, each target snapped to the strongest
  nearby boundary (record end, then line end, then any character), one piece more when a limit fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_starts(raw: bytes) -> np.ndarray:
    """Offsets of the four-line records and the end of the text; lines left over form the last record."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    starts = np.concatenate(([0], ends[3::4]))
    if starts[-1] != len(raw):
        starts = np.concatenate((starts, [len(raw)]))
    return starts


def greedy_pieces(raw: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first byte, length) of the pieces of a text; see split_records."""
    cut = record_starts(raw)
    last = len(cut) - 1
    out, i = [], 0
    while i < last:
        if cut[i + 1] - cut[i] > limit:
            start, end = int(cut[i]), int(cut[i + 1])
            while True:
                stop = min(start + limit, end)
                out.append((start, stop - start))
                if stop == end:
                    break
                start = stop - overlap
            i += 1
            continue
        j = int(np.searchsorted(cut, cut[i] + limit, side="right")) - 1  # records i..j-1 fit
        out.append((int(cut[i]), int(cut[j] - cut[i])))
        if j == last:
            break
        i = j - 1 if j - i > 1 and cut[j + 1] - cut[j - 1] <= limit else j
    return out


def balanced_pieces(raw: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of nearly equal length; each begins `overlap` bytes or less before the end of the one before."""
    size = len(raw)
    if size <= limit:
        return [(0, size)] if size else []
    records = record_starts(raw)
    lines = np.concatenate(([0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1, [size]))
    count = -(-(size - overlap) // (limit - overlap))
    while True:
        reach = (size / count) / 4
        cuts = [0]
        for k in range(1, count):
            target = size * k / count
            for marks in (records, lines):
                at = int(np.searchsorted(marks, target))
                near = min((int(x) for x in marks[max(at - 1, 0) : at + 1]), key=lambda x: abs(x - target))
                if abs(near - target) <= reach and near > cuts[-1]:
                    break
            else:
                near = int(target)
                while near > cuts[-1] + 1 and raw[near] & 0xC0 == 0x80:
                    near -= 1
            cuts.append(near)
        cuts.append(size)
        out = [(0, cuts[1])]
        for a, b in zip(cuts[1:-1], cuts[2:]):
            back = records[np.searchsorted(records, a - overlap)]
            begin = int(back) if back < a else a - overlap
            while begin < a and raw[begin] & 0xC0 == 0x80:
                begin += 1
            out.append((begin, b - begin))
        if all(0 < n <= limit for _, n in out):
            return out
        count += 1


def _run(limit: int, overlap: int, place):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, first, length = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = place(text.encode("utf-8"), limit, overlap)
                ids += [key] * len(pieces)
                no += range(1, len(pieces) + 1)
                first += [p for p, _ in pieces]
                length += [n for _, n in pieces]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(first, pa.int64()), pa.array(length, pa.int64())],
                names=["id", "piece_no", "first_byte", "n_bytes"],
            )

    return run


def split_records(
    df: DataFrame, id_col: str, text_col: str, limit: int = 4096, overlap: int = 256, balanced: bool = False
) -> DataFrame:
    """(id, piece_no, first_byte, n_bytes): the pieces of every text over `limit` bytes of UTF-8.

    Greedy: a piece holds as many whole records as fit; the next one begins again with the last record of
    the piece before if that has several and the record and its successor fit together, else with the record
    after.  A record over the limit stands alone, cut every `limit` bytes with `overlap` bytes repeated; such
    cuts may fall inside a character.  Balanced: the least number of pieces of nearly equal length, cut at the strongest boundary near
    each target and never inside a character; limit and overlap must differ by 4 or more.  Texts within the limit, empty or null ones give no rows; a null id is
    kept as null; repeated rows give repeated pieces; lines after the last full record form a record; other
    columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if balanced and limit - overlap < 4:
        raise ValueError("balanced pieces must have room for a character")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        F.octet_length("text") > limit
    )
    place = balanced_pieces if balanced else greedy_pieces
    return src.mapInArrow(_run(limit, overlap, place), "id long, piece_no int, first_byte long, n_bytes long")
