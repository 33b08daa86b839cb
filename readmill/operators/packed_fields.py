"""Several values packed in one field: dictionary-guided segmentation.

A dictionary of known whole values is aggregated over the corpus: quoted values with delimiters inside that stand whole between
two delimiters, and any that the caller names.  A multi-pattern automaton finds their places; dynamic programming over
field starts picks the best cover, in which a known whole value protects the delimiters inside it, and everything else is cut at
each delimiter.  The dictionary goes to the tasks once its size was checked; beyond `DICTIONARY_BYTES` every batch has one of
its own values, which gives the same fields, as a value that is quoted in a text is in the dictionary of its batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.plans.runtime import copy_number, written

DELIMITERS = ";,|:\t"
QUOTES = "\"'"
_CUT = re.compile(f"[{DELIMITERS}]")
#: A quoted value that begins at a field start.
_QUOTED = re.compile(rf""" *("(?:[^"]|"")*"|'(?:[^']|'')*') *(?=[{DELIMITERS}]|$)""")
_STARTS = re.compile(rf"""(?:^|[{DELIMITERS}]) *["']""")
#: Cost of a field: a known value is preferred to plain text, plain text to text with an open quote.
KNOWN, PLAIN, OPEN = 0, 1, 2
#: Text of a dictionary that is sent to the tasks.
DICTIONARY_BYTES = 16 << 20


def mine(text: str) -> set[str]:
    """Quoted values with a delimiter inside that may stand whole in a text."""
    out = set()
    for m in _STARTS.finditer(text):
        q = _QUOTED.match(text, m.end() - 1)
        if q and _CUT.search(q.group(1)):
            out.add(q.group(1))
    return out


def cover(text: str, spans: Sequence[tuple[int, int]]) -> list[str]:
    """The fields of the cheapest cover; spans are the places of known whole values."""
    if not spans:
        return _CUT.split(text)
    n = len(text)
    at: dict[int, list[int]] = {}
    for a, b in spans:
        at.setdefault(a, []).append(b)
    best: dict[int, tuple[int, int]] = {n + 1: (0, n + 1)}  # field start -> (cost to the end, end of the field)
    starts = [0, *(m.end() for m in _CUT.finditer(text))]
    for start in reversed(starts):
        m = _CUT.search(text, start)
        end = m.start() if m else n
        body = start
        while body < n and text[body] == " ":
            body += 1
        choices = []
        for stop in at.get(body, ()):
            after = stop
            while after < n and text[after] == " ":
                after += 1
            if (after == n or text[after] in DELIMITERS) and after + 1 in best:
                choices.append((KNOWN + best[after + 1][0], -after))
        opens = body < end and text[body] in QUOTES and text[body:end].rstrip(" ")[-1] != text[body]
        choices.append(((OPEN if opens else PLAIN) + best[end + 1][0], -end))
        cost, stop = min(choices)
        best[start] = (cost, -stop)
    out, start = [], 0
    while start <= n:
        end = best[start][1]
        out.append(text[start:end])
        start = end + 1
    return out


def value(field: str) -> str:
    """Blanks around it dropped; of a quoted value the marks, too, and doubled marks made single."""
    field = field.strip(" ")
    q = field[:1]
    if q and q in QUOTES and len(field) > 1 and field[-1] == q:
        inner = field[1:-1]
        if q not in inner.replace(q + q, ""):
            return inner.replace(q + q, q)
    return field


def _machine(words: Iterable[str]) -> ahocorasick.Automaton | None:
    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, len(w))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def _segment(known: tuple[str, ...], complete: bool):
    """Fields of each text; `complete` says that `known` has the quoted values of the corpus, otherwise each batch adds its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(known)
        for b in batches:
            texts = b.column(1).to_pylist()
            if not complete:
                machine = _machine({*known, *(w for t in texts if '"' in t or "'" in t for w in mine(t))})
            ids, pos, out = [], [], []
            for key, t in zip(b.column(0).to_pylist(), texts):
                spans = [(e + 1 - n, e + 1) for e, n in machine.iter(t)] if machine else []
                for p, field in enumerate(cover(t, spans), 1):
                    v = value(field)
                    if v:
                        ids.append(key)
                        pos.append(p)
                        out.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(out, pa.string())],
                names=["id", "pos", "field_text"],
            )

    return run


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = Counter(w for t in b.column(0).to_pylist() for w in mine(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["value", "n"])


def value_dictionary(df: DataFrame, packed: Column) -> DataFrame:
    """(value, n): quoted whole values with a delimiter inside, over all texts, with the number of texts that have them."""
    quoted = df.select(packed.alias("t")).filter("t rlike '[\"\\']'")
    return quoted.mapInArrow(_mined, "value string, n long").groupBy("value").agg(F.sum("n").alias("n"))


def bounded_values(dictionary: DataFrame, limit: int) -> tuple[str, ...] | None:
    """The values of a dictionary, or None if their text is longer than the limit; it is measured before anything is collected."""
    stored = written(dictionary.select("value"))
    if (stored.agg(F.sum(F.octet_length("value"))).first()[0] or 0) > limit:
        return None
    return tuple(sorted(r.value for r in stored.collect()))


def description(tag: Column) -> Column:
    """All of a title after its first space; null without one."""
    at = F.instr(tag, " ")
    return F.when(at > 0, F.substr(tag, at + 1))


def split_values(df: DataFrame, id_col: str, packed: Column, known: Sequence[str] = (), dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(id, pos, field_text): one row per non-empty value of a packed text; pos counts empty values, too.

    The text is split at each of ``; , | :`` and tab outside quotes.  A value that begins with a quotation mark is
    quoted up to the matching mark (a doubled one stands for one); a mark without a match, or followed by
    other text, is plain.  `known` names whole values that may hold delimiters without being quoted.  Null and
    empty texts give no rows; rows that repeat an id count once, those with a null id are all kept; other
    columns are ignored.
    """
    values = bounded_values(value_dictionary(df, packed), dictionary_bytes)
    src = df.select(F.col(id_col).cast("long").alias("id"), packed.alias("t")).filter("t <> ''")
    once = src.withColumn("_copy", copy_number("id")).groupBy("id", "_copy").agg(F.max("t").alias("t")).select("id", "t")
    return once.mapInArrow(
        _segment((*known, *(values or ())), values is not None), "id long, pos int, field_text string"
    )
