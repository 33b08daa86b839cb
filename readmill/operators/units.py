"""Quantities recorded in different units: base qualities in the unit of their run.

A run's unit comes from three sources, in this order of authority: its values (every true score lies in
0..41, so most candidates are ruled out), its note (segmented by dynamic programming into prefixes, roots, exponents and
numbers over tries), and the recorded offset.  The values are reduced to a row of aggregates per run; the units are chosen from
those rows by the tasks and stored as a small table, which the planner broadcasts as long as its size allows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions.flat import flat
from readmill.plans.runtime import copy_number, written

TOP = 41
OFFSETS = (33, 59, 64)
#: Between the numbers of a list.
SEPARATORS = r",;:|/\s"
#: Words of notes.  Prefixes scale a root; roots name a quantity with its dimension; exponents introduce a number that
#: the quantity was multiplied with, divided by, or that is its unit.
PREFIXES = {
    "deci": 0.1, "tenth": 0.1, "tenths": 0.1, "centi": 0.01, "hundredth": 0.01, "hundredths": 0.01, "milli": 0.001, "thousandth": 0.001, "thousandths": 0.001,
    "micro": 1e-6, "millionths": 1e-6, "per cent": 0.01, "percent": 0.01, "%": 0.01, "per hundred": 0.01, "parts per hundred": 0.01, "per mille": 0.001, "‰": 0.001,
    "per thousand": 0.001, "parts per thousand": 0.001, "per million": 1e-6, "parts per million": 1e-6, "ppm": 1e-6, "deca": 10.0, "tenfold": 0.1,
}
ROOTS = {
    "phred": "score", "score": "score", "scores": "score", "quality value": "score", "quality values": "score", "q-score": "score", "q-scores": "score",
    "decibel": "score", "decibels": "score", "db": "score", "bel": "bel", "bels": "bel",
    "probability": "probability", "probabilities": "probability", "chance": "probability", "chances": "probability", "likelihood": "probability",
    "error rate": "probability", "error rates": "probability", "p": "probability", "odds": "odds",
    "log10": "log", "log 10": "log", "log": "log", "logarithm": "log", "decadic logarithm": "log", "common logarithm": "log", "ln": "ln", "natural log": "ln", "natural logarithm": "ln",
    "character": "code", "characters": "code", "character code": "code", "code": "code", "codes": "code", "ascii": "code", "offset": "code",
}
EXPONENTS = {
    "x": "times", "×": "times", "*": "times", "times": "times", "multiplied by": "times", "multiplied with": "times", "scaled by": "times",
    "divided by": "over", "over": "over", "units of": "unit", "unit of": "unit", "unit is": "unit", "steps of": "unit", "multiples of": "unit",
    "-": "sign", "minus": "sign", "negative": "sign", "negated": "sign",
}
NUMBERS = {
    "bang": 33, "exclamation mark": 33, "exclamation point": 33, "semicolon": 59, "at-sign": 64, "at sign": 64, "@": 64,
    "thirty-three": 33, "fifty-nine": 59, "sixty-four": 64, "ten": 10, "a hundred": 100, "one hundred": 100, "hundred": 100, "a thousand": 1000, "one thousand": 1000, "thousand": 1000,
}
#: Prior weight of each dimension for a field of base qualities.
PRIORS = {"score": 3.0, "code": 2.5, "probability": 2.0, "log": 1.8, "bel": 1.0, "ln": 0.8, "odds": 0.6}
_LITERAL = re.compile(r"10\s?(?:\^|\*\*)\s?(-?\d+)|(\d+(?:\.\d+)?)(?:e(-?\d+))?(?![\w^])")
_SUPERSCRIPT = re.compile("10([⁻⁰¹²³⁴⁵⁶⁷⁸⁹]+)")
_PLAIN = str.maketrans("⁻⁰¹²³⁴⁵⁶⁷⁸⁹−–", "-0123456789--")


class Trie:
    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def ends(self, text: str, start: int) -> Iterator[tuple[int, str]]:
        """(end, word) of the words that begin at start."""
        node = self.root
        for i in range(start, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            if "" in node:
                yield i + 1, node[""]


_TRIES = [("prefix", Trie(PREFIXES)), ("root", Trie(ROOTS)), ("exponent", Trie(EXPONENTS)), ("number", Trie(NUMBERS))]


@dataclass(frozen=True)
class Reading:
    """What a note says: a dimension, the factor of a stored value, and an offset if characters are meant."""

    dimension: str
    scale: float
    offset: int | None


def segment(note: str | None) -> list[tuple[str, str | float]]:
    """Best cover of a note by known words and numbers: (kind, word or value); what no trie knows is skipped at a cost.

    The score of a cover is the number of letters it explains, long words first, with a root's dimension prior.
    """
    text = _SUPERSCRIPT.sub(lambda m: "10^" + m.group(1), note or "").translate(_PLAIN)
    text = re.sub(r"\s+", " ", text.lower()).strip()
    n = len(text)
    best: list[tuple[float, tuple]] = [(0.0, ())] * (n + 1)
    # a word goes on between two letters or two digits
    inside = [0 < i < n and (text[i - 1].isalpha() and text[i].isalpha() or text[i - 1].isdigit() and text[i].isdigit()) for i in range(n + 1)]
    glued = {end for i in range(n) if not inside[i] for end, _ in _TRIES[0][1].ends(text, i)}
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        if inside[i] and i not in glued:
            continue  # words begin at a word's start or behind a prefix
        m = _LITERAL.match(text, i) if not inside[i] else None
        if m:
            value = 10.0 ** int(m[1]) if m[1] else float(m[2]) * 10.0 ** int(m[3] or 0)
            gain = (m.end() - i) ** 1.2
            if best[m.end()][0] + gain > best[i][0]:
                best[i] = (best[m.end()][0] + gain, (("number", value), *best[m.end()][1]))
        for kind, trie in _TRIES:
            for end, word in trie.ends(text, i):
                # a prefix may be glued to a root, other words end where a word ends
                if inside[end] and (kind != "prefix" or not any(True for _ in _TRIES[1][1].ends(text, end))):
                    continue
                gain = len(word) ** 1.2 + (PRIORS[ROOTS[word]] if kind == "root" else 0.0)
                if best[end][0] + gain > best[i][0]:
                    found = NUMBERS[word] if kind == "number" else word
                    best[i] = (best[end][0] + gain, ((kind, found), *best[end][1]))
    return list(best[0][1])


def read_note(note: str | None) -> Reading | None:
    """The unit that a note names; None if it names none."""
    parts = segment(note)
    roots = [ROOTS[w] for k, w in parts if k == "root"]

    def before_log(i: int) -> bool:
        """Between here and a logarithm stand only a number and a multiplication sign."""
        for kind, w in parts[i + 1 : i + 4]:
            if kind == "root":
                return ROOTS[w] in ("log", "ln")
            if kind == "prefix" or kind == "exponent" and EXPONENTS[w] != "times":
                return False
        return False

    scale, factor, op, offset = 1.0, 1.0, None, None
    for i, (kind, w) in enumerate(parts):
        if kind == "prefix":
            scale *= PREFIXES[w]
        elif kind == "exponent":
            op = EXPONENTS[w]
            if op == "sign" and before_log(i):
                factor = -factor
        elif kind == "number":
            if before_log(i):
                factor *= w
            elif op == "times":
                scale /= w
            elif op in ("over", "unit"):
                scale *= w
            elif w in OFFSETS and offset is None:
                offset = int(w)
            op = None
        else:
            op = None
    if not roots and offset is None:
        return None
    weight = {d: roots.count(d) + PRIORS[d] / 10 for d in set(roots)}
    if offset is not None:
        weight["code"] = weight.get("code", 0) + 2
    log = next((d for d in ("log", "ln") if d in weight), None)
    dimension = log or max(weight, key=lambda d: (weight[d], PRIORS[d]))
    if log:
        # the stored value is factor * log(p), a score -10 * log10(p)
        return Reading("score", scale * -10 / factor / (math.log(10) if log == "ln" else 1), None)
    return Reading(dimension, scale, offset if dimension == "code" else None)


def _scores(kind: str, scale: float, least: float, most: float) -> tuple[float, float] | None:
    """Scores of the least and the most number in a unit; None if they cannot be in it."""
    if kind == "scaled":
        return least * scale, most * scale
    lo, hi = least * scale, most * scale
    if lo <= 0 or kind == "probability" and hi > 1:
        return None
    p = (lo, hi) if kind == "probability" else (lo / (1 + lo), hi / (1 + hi))
    return -10 * math.log10(p[0]), -10 * math.log10(p[1])


def run_unit(stats: dict, note: str | None, recorded: int | None) -> tuple[str, float]:
    """(kind, parameter) of a run: ('code', offset), ('scaled', factor), ('probability', factor) or ('odds', factor).

    stats: rows, lists (rows that are lists of numbers), low and high (codes of the others), least and most (numbers), whole (all numbers
    are whole).  A unit must keep every score in 0..41; of those that do, the one that the note says, else the likeliest.
    """
    said = read_note(note)
    if (stats["lists"] or 0) * 2 <= (stats["rows"] or 0):
        low, high = stats["low"], stats["high"]
        fit = [o for o in OFFSETS if low is None or low >= o and high <= o + TOP]
        for o in (said.offset if said else None, recorded):
            if o in fit:
                return "code", float(o)
        return "code", float(fit[0] if fit else recorded if recorded in OFFSETS else OFFSETS[0])
    least, most = stats["least"] or 0.0, stats["most"] or 0.0

    def fits(kind: str, scale: float) -> float | None:
        """The share of the range that the values use, or None."""
        ends = _scores(kind, scale, least, most)
        if ends is None or min(ends) < 0 or max(ends) >= TOP + 0.5:
            return None
        return max(ends) / TOP

    if said and said.dimension != "code":
        kind = said.dimension if said.dimension in ("probability", "odds") else "scaled"
        scale = said.scale * (10 if said.dimension == "bel" else 1)
        if fits(kind, scale) is not None:
            return kind, scale
    usual = [(3.0, "scaled", 1.0), (2.0, "scaled", 0.1), (1.0, "scaled", 0.01), (0.5, "scaled", -10.0), (6.0, "probability", 1.0), (1.5, "probability", 0.01)]
    if not stats["whole"]:
        usual.append((0.8, "scaled", 10.0))
    choice = []
    for prior, kind, scale in usual:
        used = fits(kind, scale)
        # whole numbers are no probabilities, unless all are 1; a unit is likelier the more of the range it uses
        if used is not None and (kind != "probability" or not stats["whole"] or most == least == 1):
            choice.append((prior + (2 * used if kind == "scaled" else 0), kind, scale))
    return max(choice)[1:] if choice else ("scaled", 1.0)


def is_list(quality: Column) -> Column:
    """Numbers separated by commas or blanks, or a single number; a single negative one needs a point."""
    number = r"[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"
    return quality.rlike(rf"^\s*(?:{number}|-[0-9]+\.[0-9]*|-?{number}(?:[{SEPARATORS}]+-?{number})+)\s*$")


def numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each value holds) of texts that are lists of numbers."""
    clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(col, f"[{SEPARATORS}]+", " "))
    parts = pc.split_pattern(clean, " ")
    off = parts.offsets.to_numpy()
    return pc.cast(parts.flatten(), pa.float64()).to_numpy(), np.diff(off)


STATS = {"rows": "long", "lists": "long", "low": "int", "high": "int", "least": "double", "most": "double", "whole": "boolean"}


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of a batch: number of rows and of lists, range of the codes, range of the numbers, whether all are whole."""
    for b in batches:
        run = pc.fill_null(b.column(0), -(1 << 63)).to_numpy()
        lists = b.column(2).to_numpy(zero_copy_only=False)
        runs, place = np.unique(run, return_inverse=True)
        n = len(runs)
        low, high = np.full(n, 1 << 30), np.full(n, -1)
        least, most, whole = np.full(n, np.inf), np.full(n, -np.inf), np.ones(n, bool)
        if not lists.all():
            at = np.flatnonzero(~lists)
            codes, off = flat(b.column(1).take(pa.array(at)))
            np.minimum.at(low, place[at], np.minimum.reduceat(codes, off[:-1]).astype(np.int64))
            np.maximum.at(high, place[at], np.maximum.reduceat(codes, off[:-1]).astype(np.int64))
        if lists.any():
            at = np.flatnonzero(lists)
            v, k = numbers(b.column(1).take(pa.array(at)))
            head = np.cumsum(k) - k
            np.minimum.at(least, place[at], np.minimum.reduceat(v, head))
            np.maximum.at(most, place[at], np.maximum.reduceat(v, head))
            np.logical_and.at(whole, place[at], np.minimum.reduceat((v == np.floor(v)).astype(np.int8), head) == 1)
        some = np.bincount(place, lists, n).astype(np.int64)
        coded = np.bincount(place, ~lists, n) > 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(runs, mask=runs == -(1 << 63)), pa.array(np.bincount(place, minlength=n)), pa.array(some), pa.array(low.astype(np.int32), mask=~coded),
                pa.array(high.astype(np.int32), mask=~coded), pa.array(least, mask=some == 0), pa.array(most, mask=some == 0), pa.array(whole, mask=some == 0),
            ],
            names=["run", *STATS],
        )


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        units = [run_unit(r, r["quality_note"], r["quality_offset"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([k for k, _ in units], pa.string()), pa.array([float(x) for _, x in units], pa.float64())],
            names=["run", "unit", "parameter"],
        )


def run_units(df: DataFrame, quality_col: str, run_col: str, dataset: DataFrame) -> DataFrame:
    """(run, unit, parameter): the unit of each run, null for reads without one; one row per run.

    One pass over the values gives a row of aggregates per run; with the notes they are decided on by the tasks.
    """
    q = F.col(quality_col)
    src = df.select(F.col(run_col).cast("long").alias("run"), q.alias("q"), is_list(q).alias("is_list")).filter("q <> ''")
    each = src.mapInArrow(_stats, "run long, " + ", ".join(f"{k} {t}" for k, t in STATS.items()))
    merge = {"rows": F.sum, "lists": F.sum, "low": F.min, "high": F.max, "least": F.min, "most": F.max, "whole": F.bool_and}
    stats = each.groupBy("run").agg(*(merge[k](k).alias(k) for k in STATS))
    # a run that is described twice still has one unit
    notes = dataset.select(F.col("run_id").cast("long").alias("of_run"), "quality_offset", "quality_note").filter("of_run is not null")
    notes = notes.groupBy("of_run").agg(F.max("quality_offset").alias("quality_offset"), F.max("quality_note").alias("quality_note"))
    known = stats.join(notes, F.col("run") == F.col("of_run"), "left").drop("of_run")
    return written(known.mapInArrow(_choose, "run long, unit string, parameter double"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to id, unit and parameter the sum of a quality's scores and their number."""
    for b in batches:
        unit = np.asarray(b.column(2).to_pylist(), object)
        par = b.column(3).to_numpy(zero_copy_only=False)
        total, count = np.zeros(len(b)), np.zeros(len(b), np.int64)
        for kind in ("code", "scaled", "probability", "odds"):
            at = np.flatnonzero(unit == kind)
            if not len(at):
                continue
            q = b.column(1).take(pa.array(at))
            if kind == "code":
                text = q.to_pylist()
                count[at] = [len(t) for t in text]
                total[at] = [sum(t.encode("latin-1", "replace")) for t in text] - par[at] * count[at]
                continue
            v, n = numbers(q)
            v = v * np.repeat(par[at], n)
            if kind == "odds":
                v = v / (1 + v)
            if kind != "scaled":
                v = -10 * np.log10(np.maximum(v, 1e-12))
            v = np.floor(v + 0.5)
            total[at] = np.add.reduceat(v, np.cumsum(n) - n)
            count[at] = n
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), b.column(3), pa.array(total.astype(np.int64)), pa.array(count)],
            names=["id", "unit", "parameter", "phred_sum", "n"],
        )


def phred_sums(
    df: DataFrame, id_col: str, quality_col: str, run_col: str, dataset: DataFrame, but_offset: int | None = None
) -> DataFrame:
    """(id, unit, parameter, phred_sum, n) of every row with a quality, in whole Phred scores.

    Rows of characters with the offset `but_offset` are left out: they are in the common unit already.

    unit is `code` (one character per base, parameter its offset), `scaled` (numbers times parameter), `probability` or `odds`.
    A row of characters in a run of lists is read as characters with offset 33.  An empty quality has no scores and the sum 0; a null one gives no row; rows that
    repeat an id count once, those with a null id are kept; a run without a dataset row, or a null run, is judged by
    its values.
    """
    units = run_units(df, quality_col, run_col, dataset)
    src = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(quality_col).alias("q"), F.col(run_col).cast("long").alias("run")
    ).filter("q is not null")
    # one row per run: its measured size lets the planner broadcast it
    own = src.join(units.withColumnRenamed("run", "of_run"), F.expr("run <=> of_run"), "left")
    lists = is_list(F.col("q"))
    shaped = own.select(
        "id",
        "q",
        F.when((F.col("unit") != "code") & ~lists, "code").otherwise(F.coalesce("unit", F.lit("code"))).alias("unit"),
        F.when((F.col("unit") != "code") & ~lists, 33.0).otherwise(F.coalesce("parameter", F.lit(33.0))).alias("parameter"),
    )
    if but_offset is not None:
        shaped = shaped.filter(~((F.col("unit") == "code") & (F.col("parameter") == but_offset)))
    sums = shaped.mapInArrow(_sums, "id long, unit string, parameter double, phred_sum long, n long")
    picked = sums.withColumn("_copy", copy_number("id")).groupBy("id", "_copy").agg(
        *(F.first(c).alias(c) for c in ("unit", "parameter", "phred_sum", "n"))
    )
    return picked.drop("_copy")
