"""Evaluation passages inside corpus texts: q-gram lemma filtering and banded alignment.

Both sides are folded (look-alike characters, case) and written as a stream of words with single blanks.  A run of
`words` equal words with at most k edited ones among them falls into k + 1 stretches at most, of which one has words / (k + 1) equal words in a
row.  Its n characters stand on one diagonal and give n + 1 - q shared q-grams, however long the edited words are.
Shared q-grams are counted in overlapping diagonal bands per (document, item), regions that reach the bound are kept, and
round those the words are aligned within the band.  q is 16, or less for an item whose words are so short that the bound would
be lost.  The items are a stated query set: their q-gram index is sent to the workers only after its size was checked; a
larger set is worked off in slices of that size.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions.flat import doubled_names, symbol_values
from readmill.llm.lookalike import rewriter_for

WORD = re.compile(r"[^\W_]+")
#: Characters of items that one pass over the corpus takes.
SLICE = 4_000_000
#: Slots of the filter per q-gram, and at least so many bits of a slot.
SPARSE, TABLE_BITS = 16, 16

_CLASS = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isalnum():
        _CLASS[_c] = _c
# letters beyond the first 256 code points all look alike to the filter
_CLASS[63] = 63


def fold(text: str) -> str:
    return rewriter_for(())(text).lower()


def stream(folded: str) -> np.ndarray:
    """Words in single bytes with one blank between; lossy outside Latin-1, alike on both sides."""
    raw = np.frombuffer(folded.encode("latin-1", "replace"), np.uint8)
    if (raw == 63).any():
        # a question mark is either itself (a separator) or stands for another character
        raw = raw.copy()
        at = np.flatnonzero(raw == 63)
        raw[at] = [63 if folded[i].isalnum() else 32 for i in at.tolist()]
    cls = _CLASS[raw]
    keep = np.empty(len(cls), bool)
    if len(cls):
        blank = cls == 32
        keep[0] = not blank[0]
        np.logical_not(blank[1:] & blank[:-1], out=keep[1:])
    return cls[keep]


def grams(s: np.ndarray, q: int = 16) -> np.ndarray:
    """A 64-bit name of the q bytes at each position."""
    if len(s) < q:
        return np.zeros(0, np.uint64)
    if q != 16:
        return doubled_names(symbol_values(s), q)
    w = s.astype(np.uint16)
    w = w[:-1] | w[1:] << np.uint16(8)
    w = w.astype(np.uint32)
    w = w[:-2] | w[2:] << np.uint32(16)
    w = w.astype(np.uint64)
    w = w[:-4] | w[4:] << np.uint64(32)
    return w[:-8] * np.uint64(0x9E3779B97F4A7C15) + (w[8:] ^ (w[8:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


class Item(NamedTuple):
    id: int
    words: list[str]
    where: dict[str, list[int]]  # the places of each word
    stream: np.ndarray
    ends: np.ndarray  # where each word begins in the stream, and one behind the last
    shortest: int  # least length of a stretch that a run must hold unedited


def prepared(items: list[tuple[int, str]], words: int, edits: int) -> list[Item]:
    """Items of at least `words` words."""
    row = -(-words // (edits + 1))
    out = []
    for key, text in items:
        folded = fold(text)
        own = WORD.findall(folded)
        if len(own) >= words:
            ends = np.cumsum([0, *(len(w) + 1 for w in own)])
            where: dict[str, list[int]] = {}
            for j, w in enumerate(own):
                where.setdefault(w, []).append(j)
            out.append(Item(key, own, where, stream(folded).copy(), ends, int((ends[row:] - ends[:-row]).min()) - 1))
    return out


class Index:
    """The q-grams of items with their places."""

    def __init__(self, items: list[Item], q: int, words: int, edits: int):
        self.q, self.edits, self.least, self.items = q, edits, words, items
        #: a band is twice as wide, two bands overlap by half; width is the same in words of one letter
        self.half = 16
        self.width = self.half // 2 + 2 + edits
        self.bound = np.array([x.shortest + 1 - q for x in items], np.int64)
        each = []
        for x in items:
            # the stream may begin with a blank
            lead = int(len(x.stream) > 0 and x.stream[0] == 32)
            each.append(grams(x.stream[lead:], q))
        empty = np.zeros(0, np.int64)
        key = np.concatenate(each) if each else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner = np.repeat(np.arange(len(items)), [len(g) for g in each])[order] if each else empty
        self.place = np.concatenate([np.arange(len(g)) for g in each])[order] if each else empty
        self.bits = max(TABLE_BITS, (SPARSE * len(key)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.slot(self.key)] = True

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - self.bits)).astype(np.int64)

    def regions(self, g: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (doc, item, first place, last place in the document, band) of bands that reach the item's bound."""
        lo, hi = np.searchsorted(self.key, g), np.searchsorted(self.key, g, side="right")
        n = hi - lo
        rep = np.repeat(np.arange(len(g)), n)
        src = np.repeat(lo, n) + (np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n))
        if not len(rep):
            return np.zeros((0, 5), np.int64)
        d, item = doc[rep], self.owner[src]
        x = at[rep]
        diagonal = (x - self.place[src]) // self.half
        # one place of the document counts once per band and item
        rows = np.stack([np.concatenate([d, d]), np.concatenate([item, item]), np.concatenate([diagonal, diagonal + 1]), np.concatenate([x, x])], 1)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        rows = rows[new]
        head = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1))))
        count = np.diff(head, append=len(rows))
        tail = head + count - 1
        ok = count >= self.bound[rows[head, 1]]
        return np.stack([rows[head, 0], rows[head, 1], rows[head, 3], rows[tail, 3], rows[head, 2]], 1)[ok]

    def aligned(self, part: list[str], item: int, beside: int) -> bool:
        """Banded alignment of words with the item's, the first of them beside its word number `beside`, give or take the width.

        True for a run of `least` equal words with at most `edits` words replaced, left out or put in between.  Only the equal
        pairs of the band are visited, each with the longest runs that end at it.
        """
        where, least, k = self.items[item].where, self.least, self.edits
        rows: deque[dict[int, list[int]]] = deque(maxlen=k + 1)  # of the words before: own word -> longest run for 0 .. k edits
        for i, w in enumerate(part):
            now = {}
            for j in where.get(w, ()):
                if abs(j - beside - i) > self.width:
                    continue
                best = [1] * (k + 1)
                for skipped, row in enumerate(rows):
                    for left_out in range(k + 1):
                        before = row.get(j - 1 - left_out)
                        if before is not None:
                            cost = max(skipped, left_out)
                            for e in range(cost, k + 1):
                                best[e] = max(best[e], before[e - cost] + 1)
                if best[k] >= least:
                    return True
                now[j] = best
            rows.appendleft(now)
        return False


def indexes(items: list[tuple[int, str]], words: int, edits: int) -> list[Index]:
    """One index per q: 16, or the least stretch of the items that have shorter ones."""
    of: dict[int, list[Item]] = {}
    for x in prepared(items, words, edits):
        of.setdefault(min(16, x.shortest), []).append(x)
    return [Index(x, q, words, edits) for q, x in sorted(of.items())]


def _search(found_by: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            found: list[tuple[int, int]] = []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1_000_000):
                    size += len(texts[hi])
                    hi += 1
                found += _search_block(found_by, ids[lo:hi], texts[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())],
                names=["id", "item"],
            )

    return run


def _search_block(found_by: list[Index], ids: list[int], texts: list[str]) -> list[tuple[int, int]]:
    folded = [fold(t) for t in texts]
    streams = [stream(t) for t in folded]
    off = np.concatenate(([0], np.cumsum([len(s) + 1 for s in streams])))
    wall = np.full(1, 1, np.uint8)
    whole = np.concatenate([x for s in streams for x in (s, wall)])
    words: dict[int, list[str]] = {}
    out = set()
    for index in found_by:
        g = grams(whole, index.q)
        hit = np.flatnonzero(index.table[index.slot(g)])
        if not len(hit):
            continue
        doc = np.searchsorted(off, hit, side="right") - 1
        for d, item, first, last, band in index.regions(g[hit], doc, hit - off[doc]).tolist():
            one = index.items[item]
            if (ids[d], one.id) in out:
                continue
            # filter bytes and folded text have the same words in the same order
            s = streams[d]
            lead = int(s[0] == 32)
            at = int((s[lead : first + 1] == 32).sum())
            count = int((s[first : last + index.q] == 32).sum()) + 1
            if d not in words:
                words[d] = WORD.findall(folded[d])
            # a run reaches that far to both sides of a stretch
            around = index.least + index.edits
            begin = max(0, at - around)
            there = int(np.searchsorted(one.ends, first - band * index.half, side="right")) - 1
            if index.aligned(words[d][begin : at + count + around], item, there - (at - begin)):
                out.add((ids[d], one.id))
    return sorted(out)


def leaked_items(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str,
    item_text_col: str,
    words: int = 13,
    edits: int = 0,
) -> DataFrame:
    """(id, item): documents whose text holds at least `words` consecutive words of an item.

    Words are unbroken strings of letters and digits, compared as they look and without case; with edits > 0
    that many words may be replaced, left out or put in between those of a run.  Null texts and ids, and items shorter than `words` words, take no part;
    rows that repeat a document or item count once.  An empty side gives no rows.
    """
    rows = (
        items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
        .filter("id is not null and text is not null")
        .distinct()
    )
    slices = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // SLICE))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        "id is not null and text is not null"
    )
    out = None
    for k in range(slices):
        part = rows.filter(F.expr(f"pmod(xxhash64(id), {slices}) = {k}")).orderBy("id").collect()
        found = src.mapInArrow(_search(indexes([(r.id, r.text) for r in part], words, edits)), "id long, item long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
