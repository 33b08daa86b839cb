"""Adaptive order-k models with a range coder, for the bases and qualities of blocks.

Blocks are coded independently of each other, so a task codes many of them side by side: every step takes the next symbol of all
blocks of a group at once (a block is a lane).  Only contexts that a lane meets have counts.  The format is this library's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions.bases import BASE_ORDER, LOSSY_BINS
from readmill.functions.flat import flat

#: Added to the count of a symbol when it was met; counts are halved before their sum reaches the limit.
STEP = 2
LIMIT = 1 << 16
#: Bytes of the counts, and symbols, of the lanes that are coded side by side; a longer lane is coded alone.
GROUP_BYTES = 384 << 20
GROUP_SYMBOLS = 2_000_000
#: Symbols of the blocks whose streams are made at once.
BATCH_SYMBOLS = 4_000_000
_TOP, _BOTTOM, _ALL = 1 << 24, 1 << 16, (1 << 32) - 1
#: Times four counts of 16 bits in a word: their sums from the first one on.
_SUMS = np.uint64(0x0001000100010001)
_FIELD = np.uint64(0xFFFF)


class Model(NamedTuple):
    """Symbols 0 .. size - 1, coded by the `order` symbols before them and one of `sides` classes of their place."""

    size: int
    order: int
    sides: int = 1

    @property
    def contexts(self) -> int:
        return self.sides * self.size**self.order

    @property
    def full(self) -> int:
        """Counts with a larger sum are halved when the next symbol was met."""
        return LIMIT - 2 * self.size - STEP

    @property
    def levels(self) -> int:
        """Levels of a tree of four branches over the symbols."""
        return max(1, -(-(self.size - 1).bit_length() // 2))

    def slots(self, length: int) -> int:
        """Places for the contexts of a lane: one each, or four times as many as it can meet."""
        return min(self.contexts, 1 << max(4, (4 * length - 1).bit_length()))

    def lane_bytes(self, length: int) -> int:
        """Most bytes of the counts of a lane."""
        return min(length, self.contexts) * (8 + 8 * sum(4**k for k in range(self.levels))) + 4 * self.slots(length)


def _groups(model: Model, length: np.ndarray) -> Iterator[np.ndarray]:
    """Lanes by falling length, as many at a time as the limits allow."""
    group: list[int] = []
    held = symbols = 0
    for k in np.argsort(-length, kind="stable").tolist():
        # the first lane of a group is its longest, its places are those of all
        n = int(length[k])
        size = model.lane_bytes(n) + 4 * (model.slots(int(length[group[0]])) - model.slots(n) if group else 0)
        if group and (held + size > GROUP_BYTES or symbols + n > GROUP_SYMBOLS):
            yield np.array(group)
            group, held, symbols, size = [], 0, 0, model.lane_bytes(n)
        group.append(k)
        held, symbols = held + size, symbols + n
    if group:
        yield np.array(group)


def _steps(length: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(begin of each step and the end, place of each symbol), where all lanes' symbols of a step stand together; lanes by falling length."""
    active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
    begin = np.concatenate(([0], np.cumsum(active)))
    pos = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return begin.tolist(), begin[pos] + np.repeat(np.arange(len(length)), length)


def _joined(parts: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(parts[k] for k in group.tolist())])


def _contexts(model: Model, x: np.ndarray, length: np.ndarray, side: np.ndarray | None, fresh: np.ndarray | None) -> np.ndarray:
    """Context of each symbol of lanes that stand one after the other, different in different lanes."""
    place, new = np.arange(len(x)), np.zeros(len(x), bool)
    new[(np.cumsum(length) - length)[length > 0]] = True
    if fresh is not None:
        new |= fresh != 0
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    out = np.repeat(np.arange(len(length)) * model.contexts, length)
    for k in range(1, model.order + 1):
        out[k:] += np.where(since[k:] >= k, x[:-k] * model.size ** (k - 1), 0)
    return out if side is None else out + side * model.size**model.order


def _adaptive(model: Model, context: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the counts of the lesser symbols, count, sum of all) that each symbol meets in its context."""
    by = np.argsort(context, kind="stable")
    place = np.arange(len(x))
    key, v = context[by], x[by]
    head = np.concatenate((np.ones(min(len(x), 1), bool), key[1:] != key[:-1]))
    below, count, total = v.copy(), np.ones(len(x), np.int64), np.full(len(x), model.size)
    starts = np.flatnonzero(head)
    sizes = np.diff(starts, append=len(x))
    often = sizes > (model.full - model.size) // STEP
    for a, end in zip(starts[often].tolist(), (starts + sizes)[often].tolist()):
        counts = np.ones(model.size, np.int64)
        while a < end:  # a piece from each halving on
            head[a] = True
            b = min(end, a + max(0, (model.full - int(counts.sum())) // STEP + 1) + 1)
            w = v[a:b]
            below[a:b], count[a:b], total[a:b] = (np.cumsum(counts) - counts)[w], counts[w], counts.sum()
            counts = (counts + STEP * np.bincount(w, minlength=model.size) + 1) >> 1
            a = b
    starts = np.flatnonzero(head)
    sizes = np.diff(starts, append=len(x))
    a, b = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    total += STEP * (place - a)
    # bit by bit: pieces are parted into symbols with a 0 and with a 1, the latter pass the 0s that were met before
    at = place
    for bit in range((model.size - 1).bit_length() - 1, -1, -1):
        more = np.flatnonzero(b - a > 1)
        at, a, b = at[more], a[more], b[more]
        one = (v[at] >> bit & 1).astype(bool)
        here = np.arange(len(at))
        first = here - (place[more] - a)  # of the piece, among those that are left
        length = b - a
        zeros = np.concatenate(([0], np.cumsum(~one)))
        before, of_piece = zeros[:-1] - zeros[first], zeros[first + length] - zeros[first]
        below[at[one]] += STEP * before[one]
        to = np.where(one, first + of_piece + here - first - before, first + before)
        starts_, ends_ = np.where(one, first + of_piece, first), np.where(one, first + length, first + of_piece)
        at_, a, b = np.empty_like(at), np.empty_like(a), np.empty_like(b)
        at_[to], a[to], b[to] = at, starts_, ends_
        at, place = at_, here
    count[at] += STEP * (np.arange(len(at)) - a)
    out = np.empty((3, len(x)), np.uint32)
    out[:, by] = below, count, total
    return out[0], out[1], out[2]


def _settled(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, number of bytes) once the first bytes that are settled went; a width that is too small is cut to settle one."""
    x = low ^ (low + width)
    n = (x < _TOP).view(np.uint8) + (x < 1 << 16).view(np.uint8) + (x < 1 << 8).view(np.uint8)
    shift = (n << 3).astype(np.uint32)
    low, width = low << shift, width << shift
    small = np.flatnonzero(width < _BOTTOM)
    while len(small):
        cut = low[small]
        rest = (-cut & (_BOTTOM - 1)) << 8
        low[small], width[small] = cut << 8, rest
        n[small] += 1
        small = small[rest < _BOTTOM]
    return low, width, n


def encode(model: Model, symbols: list[np.ndarray], sides: list[np.ndarray] | None = None, fresh: list[np.ndarray] | None = None) -> list[bytes]:
    """Codes of the lanes.  sides: class of each place; fresh: True where the symbols before count as 0s (a read begins)."""
    out = [b""] * len(symbols)
    length = np.array([len(x) for x in symbols], np.int64)
    for group in _groups(model, length):
        side, new = (None if p is None else _joined(p, group) for p in (sides, fresh))
        for k, data in zip(group.tolist(), _encode(model, _joined(symbols, group), length[group], side, new)):
            out[k] = data
    return out


def _encode(model: Model, x: np.ndarray, length: np.ndarray, side: np.ndarray | None, fresh: np.ndarray | None) -> list[bytes]:
    begin, at = _steps(length)
    below, count, total = (np.empty(len(x), np.uint32) for _ in range(3))
    below[at], count[at], total[at] = _adaptive(model, _contexts(model, x, length, side, fresh), x)
    sent, sizes, last = np.empty(len(x), np.uint32), np.empty(len(x), np.uint8), np.zeros(len(length), np.uint32)
    low, width = np.zeros(len(length), np.uint32), np.full(len(length), _ALL, np.uint32)
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a < len(low):
            last[b - a : len(low)] = low[b - a :]
            low, width = low[: b - a], width[: b - a]
        unit = width // total[a:b]
        low = low + below[a:b] * unit
        sent[a:b] = low
        low, width, sizes[a:b] = _settled(low, unit * count[a:b])
    last[: len(low)] = low
    size = sizes[at]
    data = sent[at].astype(">u4").view(np.uint8).reshape(-1, 4)[:, :3][np.arange(3) < size[:, None]]
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[np.concatenate(([0], np.cumsum(length)))].tolist()
    tails = last.astype(">u4").view(np.uint8).reshape(-1, 4)
    return [data[a:b].tobytes() + tails[k].tobytes() if length[k] else b"" for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]


class _Counts:
    """Counts of the contexts that were met: trees of four branches, a word has the sums of the symbols below each branch in 16 bits each."""

    def __init__(self, model: Model, length: np.ndarray):
        self.model, self.slots = model, model.slots(int(length.max(initial=0)))
        self.shift = 32 - (self.slots.bit_length() - 1)
        self.base = np.arange(len(length)) * self.slots
        self.row = np.zeros(len(length) * self.slots, np.int32)
        most = int(np.minimum(length, model.contexts).sum()) + 1
        self.context, self.rows = np.full(most, -1), 1
        one = np.zeros(4**model.levels, np.int64)
        one[: model.size] = 1
        self.new = self.words(one[None])
        self.tree = [np.empty((most, w.shape[1]), np.uint64) for w in self.new]
        self.flat = [w.reshape(-1) for w in self.tree]

    def words(self, counts: np.ndarray) -> list[np.ndarray]:
        """Trees of counts, from the root on."""
        out = []
        for _ in range(self.model.levels):
            four = counts.reshape(len(counts), -1, 4)
            out.insert(0, np.ascontiguousarray(four.astype("<u2")).view("<u8")[..., 0])
            counts = four.sum(2)
        return out

    def find(self, context: np.ndarray) -> np.ndarray:
        """Row of each lane's context."""
        base = self.base[: len(context)]
        all_ = self.slots == self.model.contexts
        slot = base + (context if all_ else (context * 0x9E3779B1 & _ALL) >> self.shift)
        row = self.row[slot]
        left = np.flatnonzero(self.context[row] != context)
        while len(left):
            free = row[left] == 0
            new = left[free]
            if len(new):
                a, b = self.rows, self.rows + len(new)
                self.rows = b
                self.row[slot[new]] = row[new] = np.arange(a, b)
                self.context[a:b] = context[new]
                for tree, word in zip(self.tree, self.new):
                    tree[a:b] = word
                left = left[~free]
            slot[left] = base[left] + ((slot[left] - base[left] + 1) & (self.slots - 1))
            row[left] = self.row[slot[left]]
            left = left[self.context[row[left]] != context[left]]
        return row

    def halve(self, row: np.ndarray) -> None:
        for tree, word in zip(self.tree, self.words((self.tree[-1][row].view("<u2").astype(np.int64) + 1) >> 1)):
            tree[row] = word


def decode(model: Model, data: list[bytes], length: np.ndarray, sides: list[np.ndarray] | None = None, fresh: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The symbols of the lanes; inverse of encode."""
    out = [np.zeros(0, np.int64)] * len(data)
    for group in _groups(model, length):
        side, new = (None if p is None else _joined(p, group) for p in (sides, fresh))
        for k, x in zip(group.tolist(), _decode(model, [data[k] for k in group.tolist()], length[group], side, new)):
            out[k] = x
    return out


def _decode(model: Model, coded: list[bytes], length: np.ndarray, side: np.ndarray | None, fresh: np.ndarray | None) -> list[np.ndarray]:
    begin, place = _steps(length)
    raw = np.frombuffer(b"".join(x + bytes(8) for x in coded), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.cumsum([0, *(len(x) + 8 for x in coded[:-1])])
    s = np.empty(len(place), np.int64)
    past, keep = 0, 1
    if side is not None:
        past = np.empty(len(place), np.int64)
        past[place] = side * model.size**model.order
    if fresh is not None:
        keep = np.empty(len(place), np.int64)
        keep[place] = fresh == 0
    counts = _Counts(model, length)
    low, width, history = np.zeros(len(length), np.uint32), np.full(len(length), _ALL, np.uint32), np.zeros(len(length), np.int64)
    longest, first_full = model.size**model.order, (model.full - model.size) // STEP
    for t, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        if b - a < len(low):
            low, width, history, at = low[: b - a], width[: b - a], history[: b - a], at[: b - a]
        h = history if fresh is None else history * keep[a:b]
        row = counts.find(h if side is None else h + past[a:b])
        node, x, below = row.astype(np.int64), None, None
        for k, words in enumerate(counts.flat):
            word = words[node]
            sums = word * _SUMS
            if not k:
                total = (sums >> np.uint64(48)).astype(np.uint32)
                unit = width // total
                share = np.minimum((window.take(at, mode="clip") - low) // unit, total - 1).astype(np.uint16)
            passed = (sums.view(np.uint16).reshape(-1, 4) <= share[:, None]).view(np.uint32)[:, 0]
            branch = passed * np.uint32(0x01010101) >> np.uint32(24)
            shift = (branch << np.uint32(4)).astype(np.uint64)
            lesser = (sums << np.uint64(16) >> shift & _FIELD).astype(np.uint16)
            words[node] = word + (np.uint64(STEP) << shift)
            share -= lesser
            below = lesser if below is None else below + lesser
            x = branch.astype(np.int64) if x is None else x * 4 + branch
            node = node * 4 + branch
        s[a:b] = x
        if t >= first_full:
            full = row[total > model.full]
            if len(full):
                counts.halve(full)
        history = (h * model.size + x) % longest
        low, width, n = _settled(low + below * unit, unit * (word >> shift & _FIELD).astype(np.uint32))
        at = at + n
    ends = np.concatenate(([0], np.cumsum(length))).tolist()
    s = s[place]
    return [s[a:b] for a, b in zip(ends[:-1], ends[1:])]


_INDEX = np.full(256, 255, np.int64)
_INDEX[np.frombuffer(BASE_ORDER.encode(), np.uint8)] = np.arange(len(BASE_ORDER))


def base_model(symbols: int, order: int) -> Model:
    """Four letters or eight, the latter up to order 7; more letters than that up to order 3."""
    if symbols <= 4:
        return Model(4, order)
    return Model(8, min(order, 7)) if symbols <= 8 else Model(len(BASE_ORDER), min(order, 3))


def quality_model(symbols: int, order: int, parts: int = 8) -> Model:
    """The least of 16, 32, 64, 128 and 256 symbols that holds all, with the part of the read as the side."""
    return Model(next(k for k in (16, 32, 64, 128, 256) if symbols <= k), order if symbols <= 64 else min(order, 1), parts)


class _Group(NamedTuple):
    """The streams of one kind of the blocks of a batch, with dense symbols."""

    symbols: list[np.ndarray]
    tables: list[np.ndarray]
    sides: list[np.ndarray] | None
    fresh: list[np.ndarray] | None

    def coded(self, model_of) -> tuple[list[bytes], list[bool]]:
        """(codes, whether each decodes to its stream), blocks of one model side by side."""
        models = [model_of(len(t)) for t in self.tables]
        out, same = [b""] * len(models), [True] * len(models)
        for model in set(models):
            at = [k for k, m in enumerate(models) if m == model]
            pick = lambda x: None if x is None else [x[k] for k in at]  # noqa: E731, B023
            symbols, sides, fresh = pick(self.symbols), pick(self.sides), pick(self.fresh)
            data = encode(model, symbols, sides, fresh)
            back = decode(model, data, np.array([len(x) for x in symbols], np.int64), sides, fresh)
            for k, d, a, b in zip(at, data, symbols, back):
                out[k], same[k] = d, bool((a == b).all())
        return out, same


def _dense(parts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    pairs = [np.unique(x, return_inverse=True) for x in parts]
    return [y.astype(np.uint8) for _, y in pairs], [t for t, _ in pairs]


_LOW = np.array([low for low, _ in LOSSY_BINS])


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Blocks of a batch, as many at a time as have BATCH_SYMBOLS symbols, or one."""
    reads = b.column(1).flatten()
    off = np.concatenate(([0], np.cumsum(pc.binary_length(reads.field(1)).to_numpy(zero_copy_only=False).astype(np.int64))))
    ends = off[b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py()]
    a = 0
    while a < len(b):
        n = max(1, int(np.searchsorted(ends, ends[a] + BATCH_SYMBOLS, side="right")) - 1 - a)
        yield b.slice(a, n)
        a += n


def _streams(b: pa.RecordBatch, lossy: bool) -> tuple[_Group, _Group]:
    """Bases and qualities of the blocks."""
    reads, block = b.column(1).flatten(), b.column(1).offsets.to_numpy()
    block = block - block[0]
    sequence, off = flat(reads.field(1))
    quality, _ = flat(reads.field(2))
    length = np.diff(off)
    place = np.arange(len(sequence)) - np.repeat(off[:-1], length)
    offset = np.repeat(np.repeat(b.column(2).to_numpy(), np.diff(block)), length)
    q, idx = quality.astype(np.int64) - offset, _INDEX[sequence]
    if lossy:  # every ambiguous base goes, its symbol is 0
        moved = idx > 3
        codes = np.where(moved, 0, np.maximum(np.searchsorted(_LOW, q, side="right") - 1, 1)).astype(np.uint8)
    else:
        moved = (idx > 3) & (q < 7)
        codes = np.where(moved, q + 128 + (idx - 4) * 8, q)
    cut = [slice(int(off[x]), int(off[y])) for x, y in zip(block[:-1], block[1:])]
    bases, base_tables = _dense([idx[c][~moved[c]] for c in cut])
    quals = [codes[c] for c in cut]
    quals, quality_tables = (quals, [_LOW] * len(quals)) if lossy else _dense(quals)
    part = (place * 8 // np.maximum(np.repeat(length, length), 1)).astype(np.uint8)
    fresh = place == 0
    return _Group(bases, base_tables, None, None), _Group(quals, quality_tables, [part[c] for c in cut], [fresh[c] for c in cut])


def _code(dna_order: int, quality_order: int, lossy: bool):
    quality_of = (lambda n: Model(len(LOSSY_BINS), quality_order, 8)) if lossy else (lambda n: quality_model(n, quality_order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _parts(batch)):
            bases, quals = _streams(b, lossy)
            dna, same = bases.coded(lambda n: base_model(n, dna_order))
            qual, same_too = quals.coded(quality_of)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(np.diff(b.column(1).offsets.to_numpy()).astype(np.int64)), pa.array([len(x) for x in quals.symbols], pa.int64()),
                    pa.array([len(x) for x in dna], pa.int64()), pa.array([len(x) for x in qual], pa.int64()), pa.array([x and y for x, y in zip(same, same_too)]),
                ],
                names=["block_id", "n_records", "n_symbols", "base_bytes", "quality_bytes", "round_trip"],
            )

    return run


def order_coded_sizes(reads: DataFrame, dna_order: int, quality_order: int, lossy: bool = False) -> DataFrame:
    """(block_id, n_records, n_symbols, base_bytes, quality_bytes, round_trip) of the adaptive order-k codes of each block's bases and qualities.

    reads: block_id, read_id, sequence, quality, offset; sequences of known symbols with one quality each.  Base contexts cross reads,
    quality contexts begin anew with each read.  `lossy` codes the 8 symbols of lossy storage, always with the same model.  A block is bounded by its definition; a task holds the blocks of an Arrow batch.
    """
    each = reads.groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("read_id", "sequence", "quality"))).alias("reads"), F.first("offset").cast("long").alias("offset")
    )
    return each.mapInArrow(
        _code(dna_order, quality_order, lossy), "block_id long, n_records long, n_symbols long, base_bytes long, quality_bytes long, round_trip boolean"
    )
