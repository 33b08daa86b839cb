"""Entropy codecs of a block's streams: titles field by field, 2-bit bases, Huffman codes, truncated and run-length qualities.

Each block is coded on its own by the scheme that its statistics choose; the format is this library's own.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readmill.functions.bases import BASE_ORDER
from readmill.functions.tags import SEPARATORS
from readmill.operators.titles import HISTOGRAM_LIMIT

LONGEST = 24
KEEP = {"plain": 0, "truncated": 1, "rle": 2}


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's Huffman code; ties go to the lower symbol, a single symbol gets one bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
        return out
    heap = [(int(counts[s]), int(s), [int(s)]) for s in used]
    heapq.heapify(heap)
    while len(heap) > 1:
        n, low, a = heapq.heappop(heap)
        m, other, b = heapq.heappop(heap)
        out[a + b] += 1
        heapq.heappush(heap, (n + m, min(low, other), a + b))
    if out.max() > LONGEST:  # flatten the counts until the codes are short enough for the table
        return code_lengths((counts + 1) // 2)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def huffman_encode(symbols: np.ndarray) -> bytes:
    """Number of symbols, alphabet with code lengths, packed codes."""
    symbols = symbols.astype(np.int64)
    head = np.array([len(symbols)], "<u4").tobytes()
    if not len(symbols):
        return head
    counts = np.bincount(symbols)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    n = lengths[symbols]
    owner = np.repeat(np.arange(len(symbols)), n)
    shift = np.repeat(np.cumsum(n), n) - np.arange(len(owner)) - 1
    bits = (codes[symbols][owner] >> shift) & 1
    table = np.stack([used, lengths[used]], 1).astype("<u2").tobytes()
    return head + np.array([len(used)], "<u2").tobytes() + table + np.packbits(bits.astype(np.uint8)).tobytes()


def huffman_decode(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(symbols, offset behind them)."""
    (n,) = np.frombuffer(data, "<u4", 1, at)
    at += 4
    if not n:
        return np.zeros(0, np.int64), at
    (k,) = np.frombuffer(data, "<u2", 1, at)
    used, bits = np.frombuffer(data, "<u2", 2 * int(k), at + 2).reshape(-1, 2).T.astype(np.int64)
    at += 2 + 4 * int(k)
    lengths = np.zeros(int(used.max()) + 1, np.int64)
    lengths[used] = bits
    by = used[np.lexsort((used, bits))]
    left = canonical(lengths)[by] << (LONGEST - lengths[by])
    # the symbol that would begin at every bit, by its left-aligned code; then the beginnings one after the other
    raw = np.append(np.frombuffer(data, np.uint8, -1, at), np.zeros(4, np.uint8)).astype(np.int64)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    most = min(8 * (len(raw) - 4), int(n) * int(bits.max()))
    place = np.arange(most)
    seen = window[place >> 3] >> (32 - LONGEST - (place & 7)) & (1 << LONGEST) - 1
    found = np.searchsorted(left, seen, side="right") - 1
    step = lengths[by][found].tolist()
    begin = np.empty(int(n), np.int64)
    pos = 0
    for i in range(int(n)):
        begin[i] = pos
        pos += step[pos]
    return by[found[begin]], at + (pos + 7) // 8


def bases_encode(index: np.ndarray) -> bytes:
    """Two bits a base while only the first four symbols occur, a Huffman code otherwise."""
    if len(index) and index.max() > 3:
        return b"H" + huffman_encode(index)
    bits = np.stack([index >> 1 & 1, index & 1], 1).astype(np.uint8).ravel()
    return b"2" + np.array([len(index)], "<u4").tobytes() + np.packbits(bits).tobytes()


def bases_decode(data: bytes) -> np.ndarray:
    if data[:1] == b"H":
        return huffman_decode(data, 1)[0]
    (n,) = np.frombuffer(data, "<u4", 1, 1)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, 5))[: 2 * int(n)].reshape(-1, 2)
    return bits[:, 0].astype(np.int64) * 2 + bits[:, 1]


def tail_starts(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Length of each read without its tail of 2s, at least 1 for a read with codes."""
    place = np.where(codes != 2, np.arange(len(codes)) + 1, 0)
    out = np.zeros(len(off) - 1, np.int64)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.maximum(np.maximum.reduceat(place, off[:-1][full]) - off[:-1][full], 1)
    return out


def run_pieces(codes: np.ndarray, longest: int = 255) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, codes
    head = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    size = np.diff(head, append=len(codes))
    pieces = -(-size // longest)
    value = np.repeat(codes[head], pieces)
    length = np.full(len(value), longest)
    length[np.cumsum(pieces) - 1] = size - (pieces - 1) * longest
    return value, length


def quality_scheme(codes: np.ndarray, off: np.ndarray) -> str:
    th = int((tail_starts(codes, off)[np.diff(off) > 0] - 1).sum())
    full = off[1:][np.diff(off) > 0]
    first = np.zeros(len(codes), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    runs = int((first[1:] | (codes[1:] != codes[:-1])).sum()) + bool(len(codes)) if len(codes) else 0
    rle = runs - int((codes[full - 1] == 2).sum())
    if th and (not rle or np.float32(th) / np.float32(rle) > np.float32(1.25)):
        return "rle"
    return "truncated" if not th or np.float32(len(codes)) / np.float32(th) > np.float32(1.10) else "plain"


def qualities_encode(codes: np.ndarray, off: np.ndarray) -> bytes:
    scheme = quality_scheme(codes, off)
    head = bytes([KEEP[scheme]]) + huffman_encode(np.diff(off))
    if scheme == "rle":
        value, length = run_pieces(codes)
        return head + huffman_encode(value) + huffman_encode(length)
    if scheme == "truncated":
        cut = tail_starts(codes, off)
        inside = np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off)) < np.repeat(cut, np.diff(off))
        return head + huffman_encode(cut) + huffman_encode(codes[inside])
    return head + huffman_encode(codes)


def qualities_decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    scheme = data[0]
    length, at = huffman_decode(data, 1)
    off = np.concatenate(([0], np.cumsum(length)))
    if scheme == KEEP["rle"]:
        value, at = huffman_decode(data, at)
        size, at = huffman_decode(data, at)
        return np.repeat(value, size), off
    if scheme == KEEP["truncated"]:
        cut, at = huffman_decode(data, at)
        kept, at = huffman_decode(data, at)
        out = np.full(off[-1], 2, np.int64)
        out[np.arange(len(out)) - np.repeat(off[:-1], length) < np.repeat(cut, length)] = kept
        return out, off
    return huffman_decode(data, at)[0], off


_SEPARATOR = re.compile(f"[{SEPARATORS}]")
_NUMBER = re.compile("0|[1-9][0-9]{0,17}")
#: Kinds of coded title fields.
CONST, TEXT = 0, 1
SCHEMES = {"delta_const": 2, "delta_rle": 3, "value_rle": 4, "delta_var": 5, "value_var": 6}


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers: a Huffman code where they stand close enough together and are few, else their least bits; both from the smallest on."""
    low = int(values.min(initial=0))
    head = np.array([len(values), low], "<i8").tobytes()
    v = values - low
    if not len(v):
        return head
    if int(v.max()) < HISTOGRAM_LIMIT:
        return head + b"H" + huffman_encode(v)
    bits = int(v.max()).bit_length()
    flat_ = (v[:, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8)
    return head + b"P" + bytes([bits]) + np.packbits(flat_.ravel()).tobytes()


def _unpack(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, low = (int(x) for x in np.frombuffer(data, "<i8", 2, at))
    at += 16
    if not n:
        return np.zeros(0, np.int64), at
    if data[at : at + 1] == b"H":
        v, at = huffman_decode(data, at + 1)
        return v + low, at
    bits = data[at + 1]
    size = (n * bits + 7) // 8
    flat_ = np.unpackbits(np.frombuffer(data, np.uint8, size, at + 2))[: n * bits].reshape(n, bits)
    return (flat_.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(1) + low, at + 2 + size


def title_columns(titles: list[str]) -> tuple[list[str], list[tuple[str, ...]]] | None:
    """(separators of the first title, columns of fields cut at them), or None if a title lacks one of them."""
    seps = _SEPARATOR.findall(titles[0]) if titles else []
    rows = []
    for t in titles:
        row = []
        for s in seps:
            field, found, t = t.partition(s)
            if not found:
                return None
            row.append(field)
        rows.append((*row, t))
    return seps, list(zip(*rows))


def number_scheme(v: np.ndarray) -> str:
    """Scheme of a field of numbers, as titles.number_scheme chooses it."""
    d = np.diff(v)
    by_value = int(v.max() - v.min()) < int(d.max(initial=0) - d.min(initial=0))

    def gains(x: np.ndarray) -> bool:
        size = np.diff(np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))), append=len(x)) - 1
        runs = int((size // 256).sum()) + len(size) - 1 + int(size[-1] % 256 > 0)
        return not runs or np.float32(len(v)) / np.float32(runs) > np.float32(1.25)

    if not len(d) or d.min() == d.max():
        return "delta_const"
    if not by_value and gains(d):
        return "delta_rle"
    return "value_rle" if gains(v) else "value_var" if by_value else "delta_var"


def _text(x: str) -> bytes:
    raw = x.encode()
    return np.array([len(raw)], "<u4").tobytes() + raw


def _field_encode(column: tuple[str, ...]) -> bytes:
    if len(set(column)) == 1:
        return bytes([CONST]) + _text(column[0])
    if all(_NUMBER.fullmatch(x) for x in column):
        v = np.array([int(x) for x in column], np.int64)
        scheme = number_scheme(v)
        x = v if scheme.startswith("value") else np.diff(v)
        head = bytes([SCHEMES[scheme]]) + v[:1].astype("<i8").tobytes()
        if scheme == "delta_const":
            return head + x[:1].astype("<i8").tobytes()
        return head + (b"".join(map(_pack, run_pieces(x, 256))) if scheme.endswith("rle") else _pack(x))
    raw = [x.encode() for x in column]
    return bytes([TEXT]) + _pack(np.array([len(x) for x in raw])) + huffman_encode(np.frombuffer(b"".join(raw), np.uint8))


def _field_decode(data: bytes, at: int, n: int) -> tuple[list[str], int]:
    kind, at = data[at], at + 1
    if kind == CONST:
        size = int(np.frombuffer(data, "<u4", 1, at)[0])
        return [data[at + 4 : at + 4 + size].decode()] * n, at + 4 + size
    if kind == TEXT:
        size, at = _unpack(data, at)
        chars, at = huffman_decode(data, at)
        raw, ends = chars.astype(np.uint8).tobytes(), np.cumsum(size).tolist()
        return [raw[b - k : b].decode() for b, k in zip(ends, size.tolist())], at
    first = int(np.frombuffer(data, "<i8", 1, at)[0])
    at += 8
    if kind == SCHEMES["delta_const"]:
        return [str(first + k * int(np.frombuffer(data, "<i8", 1, at)[0])) for k in range(n)], at + 8
    x, at = _unpack(data, at)
    if kind in (SCHEMES["delta_rle"], SCHEMES["value_rle"]):
        size, at = _unpack(data, at)
        x = np.repeat(x, size)
    v = x if kind in (SCHEMES["value_rle"], SCHEMES["value_var"]) else np.concatenate(([first], first + np.cumsum(x)))
    return [str(k) for k in v.tolist()], at


def titles_encode(titles: list[str]) -> bytes:
    """Field by field if all titles of a block have the template of the first one, as one text otherwise."""
    cut = title_columns(titles)
    if not titles or cut is None:
        return b"R" + huffman_encode(np.frombuffer("\n".join(titles).encode(), np.uint8))
    seps, columns = cut
    return b"T" + np.array([len(titles)], "<u4").tobytes() + _text("".join(seps)) + b"".join(map(_field_encode, columns))


def titles_decode(data: bytes, n: int) -> list[str]:
    if data[:1] == b"R":
        return huffman_decode(data, 1)[0].astype(np.uint8).tobytes().decode().split("\n") if n else []
    size = int(np.frombuffer(data, "<u4", 1, 5)[0])
    seps, at = data[9 : 9 + size].decode(), 9 + size
    columns = []
    for _ in range(len(seps) + 1):
        column, at = _field_decode(data, at, n)
        columns.append(column)
    return ["".join(x + s for x, s in zip(row, [*seps, ""])) for row in zip(*columns)]


_INDEX = np.full(256, 255, np.int64)
_INDEX[np.frombuffer(BASE_ORDER.encode(), np.uint8)] = np.arange(len(BASE_ORDER))
_SYMBOL = np.frombuffer(BASE_ORDER.encode(), np.uint8)


def encode_block(titles: list[str], sequences: list[str], qualities: list[str], offset: int) -> tuple[bytes, bytes, bytes]:
    """The three streams of a block; a base with quality below 7 that is not A, G, C or T moves into the quality stream."""
    tags = titles_encode(titles)
    off = np.concatenate(([0], np.cumsum([len(q) for q in qualities]))).astype(np.int64)
    q = np.frombuffer("".join(qualities).encode("latin-1"), np.uint8).astype(np.int64) - offset
    idx = _INDEX[np.frombuffer("".join(sequences).encode("latin-1"), np.uint8)]
    moved = (idx > 3) & (q < 7)
    codes = np.where(moved, q + 128 + (idx - 4) * 8, q)
    return tags, bases_encode(idx[~moved]), qualities_encode(codes, off)


def decode_block(tags: bytes, bases: bytes, quals: bytes, offset: int) -> tuple[list[str], list[str], list[str]]:
    codes, off = qualities_decode(quals)
    moved = codes >= 128
    idx = np.empty(len(codes), np.int64)
    idx[moved] = (codes[moved] - 112) // 8 + 2
    idx[~moved] = bases_decode(bases)
    q = np.where(moved, codes & 7, codes) + offset
    seq, qual = _SYMBOL[idx].tobytes().decode(), q.astype(np.uint8).tobytes().decode("latin-1")
    cut = lambda t: [t[a:b] for a, b in zip(off[:-1], off[1:])]
    return titles_decode(tags, len(off) - 1), cut(seq), cut(qual)


def _sizes(table: pa.Table) -> pa.Table:
    table = table.sort_by("read_id")
    t, s, q = (table.column(c).to_pylist() for c in ("tag", "sequence", "quality"))
    offset = table.column("offset")[0].as_py()
    coded = encode_block(t, s, q, offset)
    ok = decode_block(*coded, offset) == (t, s, q)
    scheme = next(k for k, v in KEEP.items() if v == coded[2][0])
    return pa.table(
        {
            "block_id": table.column("block_id")[:1], "n_records": pa.array([len(t)], pa.int64()), "raw_bytes": pa.array([sum(map(len, t)) + 2 * sum(map(len, s))], pa.int64()),
            "tag_bytes": pa.array([len(coded[0])], pa.int64()), "base_bytes": pa.array([len(coded[1])], pa.int64()), "quality_bytes": pa.array([len(coded[2])], pa.int64()),
            "title_coder": ["tokenised" if coded[0][:1] == b"T" else "raw"], "base_coder": ["huffman" if coded[1][:1] == b"H" else "bits2"], "quality_scheme": [scheme], "round_trip": [ok],
        }
    )


def coded_sizes(reads: DataFrame) -> DataFrame:
    """Per block: sizes of the coded streams, the coders chosen, and whether decoding gives the reads back.

    reads: block_id, read_id, tag, sequence, quality, offset; a block is bounded by its definition.
    """
    return reads.groupBy("block_id").applyInArrow(
        _sizes,
        "block_id long, n_records long, raw_bytes long, tag_bytes long, base_bytes long, quality_bytes long, title_coder string, base_coder string, quality_scheme string, round_trip boolean",
    )
