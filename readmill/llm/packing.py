"""Filling fixed-capacity containers with documents measured in tokens.

Documents are spread over groups of bounded token mass by a hash of the document; every group is packed on its own, so
that the work per task is bounded and nothing global is collected.  A group starts from best fit decreasing and is
improved by a swap-based local search: documents move between underfull bins, or change places one for one and two for
one, whenever that raises the sum of squared fills, until nothing raises it; a bin that becomes empty is dropped.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens that a group holds on average.
GROUP_TOKENS = 2_000_000
#: Words whose token count a worker remembers.
REMEMBERED = 400_000
#: Documents that are counted together.
BATCH = 2_000


@functools.lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts of texts, from the counts of their space-delimited chunks.

    The split pattern starts a new unit at every space that stands between two characters, so the counts of
    the chunks between such spaces add up to the count of the text; only runs of several blanks belong
    together.  A worker remembers the counts of chunks and units it has met.
    """

    CUT = "\x00"
    SINGLE = re.compile(r"(?<=\S) (?=\S)")
    # the split pattern for ASCII, where the standard library's classes are the same
    ASCII_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary
        self.units = regex.compile(PATTERN).findall
        self.chunks: dict[str, int] = {}
        self.unit: dict[str, int] = {}

    def of_chunk(self, chunk: str) -> int:
        n = 0
        for u in self.ASCII_UNITS.findall(chunk) if chunk.isascii() else self.units(chunk):
            k = self.unit.get(u)
            if k is None:
                k = len(self.encode(u))
                if len(self.unit) < REMEMBERED and len(u) < 64:
                    self.unit[u] = k
            n += k
        if len(self.chunks) < REMEMBERED and len(chunk) < 64:
            self.chunks[chunk] = n
        return n

    def cut(self, text: str) -> str:
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return self.SINGLE.sub(self.CUT + " ", text)
        return text.replace(" ", self.CUT + " ")

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain = [i for i, t in enumerate(texts) if t and self.CUT not in t]
        for i, t in enumerate(texts):
            if self.CUT in t:
                out[i] = len(self.encode(t))
        if not plain:
            return out
        parts = pc.split_pattern(pa.array([self.cut(texts[i]) for i in plain], pa.large_string()), self.CUT)
        words = parts.flatten().dictionary_encode()
        known = self.chunks
        each = np.array([n if (n := known.get(w)) is not None else self.of_chunk(w) for w in words.dictionary.to_pylist()], np.int64)
        off = parts.offsets.to_numpy()
        out[plain] = np.add.reduceat(each[words.indices.to_numpy()], off[:-1] - off[0])
        return out


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counter.count(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n))], names=["id", "n_tokens"])

    return run


def token_sizes(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row with a text."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return src.mapInArrow(_sizes(vocabulary), "id long, n_tokens long")


def first_bins(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > s:
            bisect.insort(room, (free - s, b))
    return bins


def _sums(items: list[int], sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct sizes of a bin's items, and sums of two of them."""
    v = np.array([sizes[i] for i in items], np.int64)
    one, n = np.unique(v, return_counts=True)
    two = np.add.outer(one, one)
    two = np.concatenate((two[np.triu_indices(len(one), 1)], 2 * one[n > 1]))
    return one, np.unique(two[two <= capacity])


def _chosen(items: list[int], sizes: list[int], value: int, several: int) -> list[int]:
    """`several` items (none, one or two) of a bin whose sizes add up to the value."""
    if several == 0:
        return []
    if several == 1:
        return [next(i for i in items if sizes[i] == value)]
    seen: dict[int, int] = {}
    for i in items:
        if value - sizes[i] in seen:
            return [seen[value - sizes[i]], i]
        seen.setdefault(sizes[i], i)
    raise ValueError("no such pair")


class Underfull:
    """What every underfull bin could give back for an exchange, side by side: none, one or two of its items."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        self.sums = [_sums(b, sizes, capacity) if 0 < f < capacity else None for b, f in zip(bins, self.fill.tolist())]
        self.flat: tuple[np.ndarray, ...] | None = None

    def backs(self) -> tuple[np.ndarray, ...]:
        """(bin, what comes back, of how many items), for all underfull bins."""
        if self.flat is None:
            zero = np.zeros(1, np.int64)
            there = [(b, s) for b, s in enumerate(self.sums) if s is not None]
            parts = [(b, several, v) for b, s in there for several, v in enumerate((zero, *s))]
            count = np.array([len(v) for _, _, v in parts])
            self.flat = (
                np.repeat(np.array([b for b, _, _ in parts]), count),
                np.concatenate([v for _, _, v in parts]),
                np.repeat(np.array([k for _, k, _ in parts]), count),
            )
        return self.flat

    def best(self, x: int):
        """The exchange with any underfull bin that raises the sum of squared fills most, or None.

        Moving d tokens from x to y changes the sum by 2 d (fy - fx + d), which grows with d as soon as it is
        positive: for all that y could give back, the largest that x can give within y's room is looked up.
        """
        y, back, several = self.backs()
        one, two = self.sums[x]
        both = np.union1d(one, two)
        most = back + self.capacity - self.fill[y]
        out = np.where(several == 2, *(
            np.where(at >= 0, v[at], 0) for v in (one, both) for at in [np.searchsorted(v, most, side="right") - 1]
        ))
        d = out - back
        gain = d * (self.fill[y] - self.fill[x] + d)
        gain[(d <= 0) | (y == x)] = 0
        k = int(np.argmax(gain))
        if gain[k] <= 0:
            return None
        i = np.searchsorted(one, out[k])
        return int(y[k]), int(out[k]), 1 if i < len(one) and one[i] == out[k] else 2, int(back[k]), int(several[k])

    def exchange(self, x: int, y: int, out: int, n_out: int, back: int, n_back: int) -> None:
        give, take = _chosen(self.bins[x], self.sizes, out, n_out), _chosen(self.bins[y], self.sizes, back, n_back)
        for b, less, more, d in ((x, give, take, back - out), (y, take, give, out - back)):
            self.bins[b] = [i for i in self.bins[b] if i not in less] + more
            self.fill[b] += d
            self.sums[b] = _sums(self.bins[b], self.sizes, self.capacity) if 0 < self.fill[b] < self.capacity else None
        self.flat = None


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins; every step raises the sum of squared fills.

    Every underfull bin gives, the emptiest first, to any other one.  It ends when no step raises the sum, or
    when no more bins are used than the tokens need.
    """
    state = Underfull([list(b) for b in bins], sizes, capacity)
    least = -(-int(state.fill.sum()) // capacity)
    used = int((state.fill > 0).sum())
    changed = True
    while changed and used > least:
        changed = False
        for x in np.argsort(state.fill, kind="stable").tolist():
            while state.sums[x] is not None and used > least and (step := state.best(x)):
                state.exchange(x, *step)
                used -= int(state.fill[x] == 0)
                changed = True
    return [b for b in state.bins if b]


def _pack(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "token_start"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy()
        empty = np.flatnonzero(sizes == 0)
        bins = improve(first_bins(sizes[: len(sizes) - len(empty)], capacity), sizes.tolist(), capacity)
        if len(empty):  # texts without tokens take no room
            bins = bins or [[]]
            bins[-1] = [*bins[-1], *empty.tolist()]
        where = np.empty(len(pdf), np.int64)
        for k, b in enumerate(bins):
            where[b] = k
        pdf["container_id"] = int(key[0]) * (1 << 32) + where
        return pdf[["container_id", "id", "piece_no", "token_start", "n_tokens"]]

    return run


def fill_containers(
    df: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int = 2048,
    vocabulary: str = VOCABULARY,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """(container_id, id, piece_no, token_start, n_tokens): where every document, or piece of one, goes.

    A document of at most `capacity` tokens is one piece; a larger one is cut every `capacity` tokens, counted
    from 0 by token_start.  The pieces of a container hold at most `capacity` tokens together.  Null texts are
    left out, empty ones take a place without tokens; every repeated row is placed; a null id is kept; an empty
    table gives no rows; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    # the size of a text is needed once; the groups are sized by an estimate from its bytes
    total = df.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    groups = max(1, round(total / 3.5 / group_tokens))
    sizes = token_sizes(df, id_col, text_col, vocabulary)
    step = F.lit(capacity).cast("long")
    pieces = sizes.select(
        "id",
        "n_tokens",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), step)).alias("k", "token_start"),
    ).select(
        "id",
        (F.col("k") + 1).cast("int").alias("piece_no"),
        "token_start",
        F.least(F.col("n_tokens") - F.col("token_start"), step).alias("n_tokens"),
    )
    # full pieces need no packing partner but stay in their group: a container of their own; the seeded number spreads repeated rows and
    # rows without an id, so which documents meet also depends on how the table is cut into partitions
    grouped = pieces.withColumn("g", F.expr(f"pmod(xxhash64(id, piece_no, n_tokens, rand(7)), {groups})"))
    return grouped.groupBy("g").applyInPandas(
        _pack(capacity), "container_id long, id long, piece_no int, token_start long, n_tokens long"
    )
