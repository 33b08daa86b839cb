"""Long exact spans shared between records, by recompression.

Every record is parsed bottom-up.  A round first names maximal runs of equal symbols, then pairs of a left and a right
symbol, where a universal hash of a symbol says which of both it is.  Names are content hashes, global without an exchange.
A symbol carries the stretch of text that fixes it (its own text and the neighbours that a round looked at):
wherever that stretch stands, the symbol stands, so equal substrings have the same interior symbols.

Two Spark rounds follow.

1. Reveal.  Each record gives the names of its long symbols and, for each window of `min_len` symbols, the smallest
   context (the names of a symbol and of what fixes it) among the high-level symbols that are fixed inside the window.
   What stands in two records goes on.  A long symbol in two records is itself a shared span, as its 128-bit name says.
2. Verify.  The remaining windows whose context is shared are compared by 128-bit names of their content.  Windows
   inside a shared long symbol are left to the record with the smallest id that holds it, so text that stands in many
   records is written once and not once per position and record.

No group is ever listed: both rounds are count-like aggregates with map-side combine followed by a join that
adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions.flat import NONE, doubled_names, flat, mix, symbol_values

#: Rounds after which a record that is not yet one symbol is left as it is.
MOST_ROUNDS = 60
#: Symbols that are parsed together, few enough for a processor's cache.
TOGETHER = 150_000


class Level(NamedTuple):
    """The symbols after a round, one after the other."""

    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    twin: np.ndarray  # a second name: both together have 128 bits
    left: np.ndarray  # the stretch that fixes the symbol; it reaches beyond the record if its end was looked at
    right: np.ndarray
    context: np.ndarray  # name of that stretch
    first: np.ndarray  # the record's first symbol, and its last
    last: np.ndarray


NOT_TOLD = np.zeros(0, np.int64)


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b + np.uint64(salt)))


def _runs(s: Level, low: np.ndarray, high: np.ndarray, fixed: bool) -> Level:
    """Maximal runs of equal symbols become one; both neighbours fix where a run ends (told if `fixed`)."""
    n = len(s.name)
    same = np.zeros(n, bool)
    np.equal(s.name[1:], s.name[:-1], out=same[1:])
    at = np.flatnonzero(same)
    same[at] = (s.twin[at] == s.twin[at - 1]) & ~s.first[at]
    head = np.flatnonzero(~same)
    tail = np.append(head[1:], n) - 1
    many = np.flatnonzero(tail > head)
    name, twin = s.name[head], s.twin[head]
    times = (tail - head + 1)[many].astype(np.uint64)
    name[many], twin[many] = _join(name[many], times, 11), _join(twin[many], times, 13)
    first, last = s.first[head], s.last[tail]
    start, end = s.start[head], s.end[tail]
    if not fixed:
        return Level(start, end, name, twin, NOT_TOLD, NOT_TOLD, NOT_TOLD, first, last)
    f, z = np.flatnonzero(first), np.flatnonzero(last)
    before, after = head - 1, tail + 1
    before[f], after[z] = head[f], tail[z]
    left, right = s.left[before], s.right[after]
    left[f], right[z] = low[start[f]], high[start[z]]
    context = mix(s.context[before] * np.uint64(3) + s.context[after] * np.uint64(5) + name)
    return Level(start, end, name, twin, left, right, context, first, last)


def _pairs(s: Level, low: np.ndarray, high: np.ndarray, salt: int, fixed: bool) -> Level:
    """A left symbol and the right symbol behind it become one; the neighbour that a symbol does not join fixes it."""
    n = len(s.name)
    # one bit of a universal hash of the name
    factor = mix(np.array([salt], np.uint64))[0] | np.uint64(1)
    is_left = ((s.name ^ (s.name >> np.uint64(29))) * factor) >> np.uint64(63) == 1
    second = np.zeros(n, bool)
    second[1:] = is_left[:-1] & ~is_left[1:] & ~s.first[1:]
    head = np.flatnonzero(~second)
    tail = np.append(head[1:], n) - 1
    paired = tail > head
    name, twin = s.name[head], s.twin[head]
    p = np.flatnonzero(paired)
    a = head[p]
    name[p], twin[p] = _join(s.name[a], s.name[a + 1], 23), _join(s.twin[a], s.twin[a + 1], 29)
    first, last = s.first[head], s.last[tail]
    start, end = s.start[head], s.end[tail]
    if not fixed:
        return Level(start, end, name, twin, NOT_TOLD, NOT_TOLD, NOT_TOLD, first, last)
    lefts = is_left[head]
    back, ahead = ~paired & ~lefts, ~paired & lefts
    f, z = np.flatnonzero(back & first), np.flatnonzero(ahead & last)
    before, after = head - back, tail + ahead
    before[f], after[z] = head[f], tail[z]
    left, right = s.left[before], s.right[after]
    left[f], right[z] = low[start[f]], high[start[z]]
    context = mix(s.context[before] * np.uint64(3) + s.context[after] * np.uint64(5))
    return Level(start, end, name, twin, left, right, context, first, last)


def parse(codes: np.ndarray, off: np.ndarray, top: int = MOST_ROUNDS) -> list[Level]:
    """The levels of all records; level 0 holds the symbols themselves.  What fixes a symbol is told up to round `top`."""
    n, length = len(codes), np.diff(off)
    i = np.arange(n)
    low, high = np.repeat(off[:-1] - 1, length), np.repeat(off[1:] + 1, length)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[off[:-1][length > 0]] = True
    last[off[1:][length > 0] - 1] = True
    name = symbol_values(codes, 1)
    out = [Level(i, i + 1, name, symbol_values(codes, 2), i, i + 1, name, first, last)]
    while len(out[-1].name) > int((length > 0).sum()) and len(out) <= MOST_ROUNDS:
        fixed = len(out) <= top
        out.append(_pairs(_runs(out[-1], low, high, fixed), low, high, len(out), fixed))
    return out


def top_round(min_len: int) -> int:
    """Round whose symbols are expected to be fixed by half a window: it adds three symbols to the stretch and makes symbols a third longer."""
    rounds, size, fixed = 0, 1.0, 1.0
    while 2 * (fixed + 3 * size) <= min_len:
        fixed += 3 * size
        size *= 4 / 3 if rounds else 5 / 3
        rounds += 1
    return rounds


def window_phrases(levels: list[Level], off: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows of min_len symbols, their phrases): equal windows have equal phrases.

    The phrase is the smallest context of the symbols that are fixed inside the window, in the highest round that has one; where
    there are only plain symbols, as in a long run, it names all of them.
    """
    n = int(off[-1])
    last = np.repeat(off[1:], np.diff(off))
    start = np.flatnonzero(np.arange(n) + min_len <= last)
    phrase = np.full(len(start), NONE)
    todo = np.arange(len(start))
    for level in levels[min(top_round(min_len), len(levels) - 1) : 0 : -1]:
        if not len(todo):
            break
        w = start[todo]
        # stretches are in order: those inside a window are the symbols a to b - 1
        a = np.concatenate(([0], np.cumsum(np.bincount(level.left + 1, minlength=n + 2))))[w + 1]
        b = np.concatenate(([0], np.cumsum(np.bincount(level.right, minlength=n + 2))))[w + min_len + 1]
        has = b > a
        a, b = a[has], b[has]
        if len(a):
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            ends = np.stack([a[new], b[new]], 1).ravel()
            least = np.minimum.reduceat(np.append(level.context, NONE), ends)[::2]
            phrase[todo[has]] = np.minimum(least, NONE - np.uint64(1))[np.cumsum(new) - 1]
        todo = todo[~has]
    if len(todo):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(levels[0].name)))
        phrase[todo] = np.minimum(mix(sums[start[todo] + min_len] - sums[start[todo]]), NONE - np.uint64(1))
    return start, phrase


def long_symbols(levels: list[Level], least: int) -> tuple[np.ndarray, ...]:
    """(start, end, name, twin) of the symbols of at least `least` positions, each once."""
    parts = []
    for k, s in enumerate(levels):
        at = np.flatnonzero(s.end - s.start >= least)
        if k and len(at):
            before = levels[k - 1]
            at = at[before.end[np.searchsorted(before.start, s.start[at])] != s.end[at]]
        parts.append((s.start[at], s.end[at], s.name[at], s.twin[at]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the code points and offsets of their texts (second column)."""
    for b in batches:
        _, off = flat(b.column(1))
        a = 0
        while a < len(b):
            z = max(a + 1, int(np.searchsorted(off, off[a] + TOGETHER, side="right")) - 1)
            part = b.slice(a, z - a)
            yield part, *flat(part.column(1))
            a = z


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _reveal(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, codes, off in _cut(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            levels = parse(codes, off, top_round(min_len))
            w, phrase = window_phrases(levels, off, min_len)
            record = np.searchsorted(off, w, side="right") - 1
            # neighbouring windows mostly have the same phrase
            new = np.ones(len(w), bool)
            new[1:] = (phrase[1:] != phrase[:-1]) | (record[1:] != record[:-1])
            start, _, name, twin = long_symbols(levels, 2 * min_len)
            owner = np.concatenate((record[new], np.searchsorted(off, start, side="right") - 1))
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate((phrase[new], name))),
                    _signed(np.concatenate((np.zeros(int(new.sum()), np.uint64), twin | np.uint64(1)))),
                    pa.array(ids[owner]),
                ],
                names=["h1", "h2", "id"],
            )

    return run


def _covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """True at the positions of [start, stop) of any span."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(np.maximum(stops, starts), minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def _verify(min_len: int):
    """Of records with their shared phrases and long symbols: shared spans (h1 null), and windows that are to be compared."""

    def key(record: np.ndarray, *names: np.ndarray) -> np.ndarray:
        """(record, name) as one number; both sides of a lookup use it."""
        out = mix(record.astype(np.uint64) + np.uint64(1))
        for x in names:
            out = mix(out + x)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, codes, off in _cut(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            wanted = b.column(2)
            each = wanted.flatten()
            h1, h2 = (each.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            mine = each.field(2).to_numpy(zero_copy_only=False).astype(bool)
            have = key(np.repeat(np.arange(len(b)), np.diff(wanted.offsets.to_numpy())), h1, h2)
            levels = parse(codes, off, top_round(min_len))
            start, end, name, twin = long_symbols(levels, 2 * min_len)
            owner = np.searchsorted(off, start, side="right") - 1
            ask = key(owner, name, twin | np.uint64(1))
            shared = np.isin(ask, have)
            others = shared & ~np.isin(ask, have[mine])
            # positions from which a window lies inside a shared long symbol, and inside one that another record writes
            sure, left_out = (_covered(start[x], end[x] - min_len + 1, len(codes)) for x in (shared, others))
            w, phrase = window_phrases(levels, off, min_len)
            record = np.searchsorted(off, w, side="right") - 1
            hit = np.isin(key(record, phrase, np.zeros(len(w), np.uint64)), have) & ~left_out[w]
            w, record = w[hit], record[hit]
            start, size, owner = start[shared], (end - start)[shared], owner[shared]
            none = pa.nulls(len(start), pa.int64())
            names = [_signed(doubled_names(symbol_values(codes, seed), min_len)[w]) if len(w) else pa.array([], pa.int64()) for seed in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([names[0], none]),
                    pa.concat_arrays([names[1], none]),
                    pa.array(np.concatenate((ids[record], ids[owner]))),
                    pa.array(np.concatenate((w - off[record], start - off[owner])).astype(np.int32)),
                    pa.array(np.concatenate((np.full(len(w), min_len), size)).astype(np.int32)),
                    pa.array(np.concatenate((sure[w], np.ones(len(start), bool)))),
                ],
                names=["h1", "h2", "id", "at", "size", "sure"],
            )

    return run


def shared_spans(df: DataFrame, id_col: str, text_col: str, min_len: int = 40) -> DataFrame:
    """(id, shared): for each record with a stretch of at least min_len symbols that also stands in
    another record's text, the number of its positions inside such stretches.

    The stretches must stand in records of different ids; a repeat inside one record does not count, and
    rows that repeat an id count once.  Rows with a null id or text take no part.  Records shorter than
    min_len (and empty ones) have no such stretch.  An empty input gives no rows; other columns of df are
    ignored.  min_len must be at least 2.
    """
    if min_len < 2:
        raise ValueError("min_len must be at least 2")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & (F.length("text") >= min_len)
    )
    names = src.mapInArrow(_reveal(min_len), "h1 long, h2 long, id long")
    several = names.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("_hi")).filter("lo < _hi").drop("_hi")
    wanted = (
        names.join(several.hint("merge"), ["h1", "h2"])
        .groupBy("id")
        .agg(F.collect_set(F.struct("h1", "h2", (F.col("id") == F.col("lo")).alias("mine"))).alias("wanted"))
    )
    spans = src.join(wanted.hint("merge"), "id").mapInArrow(
        _verify(min_len), "h1 long, h2 long, id long, at int, size int, sure boolean"
    )
    windows = spans.filter("h1 is not null")
    # a window inside a shared long symbol is shared, whoever else has it
    shared = (
        windows.groupBy("h1", "h2")
        .agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.bool_or("sure").alias("_sure"))
        .filter("_sure or _lo < _hi")
        .select("h1", "h2")
    )
    found = (
        windows.filter("not sure").join(shared.hint("merge"), ["h1", "h2"], "left_semi").select("id", "at", "size")
        .unionByName(spans.filter("h1 is null").select("id", "at", "size"))
    )
    each = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("s"))
    # spans in order: each adds what reaches beyond those before it
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda t, x: F.struct(
        F.greatest(t["end"], x["at"] + x["size"]).alias("end"),
        (t["n"] + F.greatest(x["at"] + x["size"] - F.greatest(x["at"], t["end"]), F.lit(0))).alias("n"),
    )
    return each.select("id", F.aggregate("s", start, add, lambda t: t["n"]).alias("shared"))
