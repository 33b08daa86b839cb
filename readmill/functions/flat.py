"""Arrow string columns as flat code-point arrays, and universal hashes over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Largest unsigned 64-bit value: "no hash here".
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all values one after the other, n + 1 offsets); a null is an empty value."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if raw.size and raw.max() >= 128:
        heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), heads[off]
    return raw, off


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def symbol_values(codes: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit value per symbol."""
    if codes.dtype == np.uint8:
        table = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 7919 + 1))
        return table[codes]
    return mix(codes.astype(np.uint64) + np.uint64(seed * 7919 + 1))


class Rolling:
    """Hashes of all substrings of a given length of a flat array."""

    def __init__(self, values: np.ndarray, seed: int = 1):
        n = len(values)
        base = (BASE + 2 * (seed - 1) * 0x1000193) % (1 << 64)
        inverse = pow(base, -1, 1 << 64)
        power = np.full(n + 1, np.uint64(base), np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.prefix[1:])
        self.back = np.full(n + 1, np.uint64(inverse), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, length: int) -> np.ndarray:
        """Hash of [i, i + length) for every i at which it fits."""
        d = self.prefix[length:] - self.prefix[: len(self.prefix) - length]
        return mix(d * self.back[: len(d)])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.prefix[starts + length] - self.prefix[starts]) * self.back[starts])


def doubled_names(values: np.ndarray, length: int) -> np.ndarray:
    """A name of values[i : i + length] for every i at which it fits.

    Names of stretches of 1, 2, 4, ... values are put together from names of their halves by a mixing step, so, other than with a
    polynomial hash, no pair of different stretches has equal names for any choice of symbol values.
    """
    if len(values) < length:
        return values[:0]
    have, out = 1, values
    while have < length:
        step = min(have, length - have)
        out = mix(out[: len(out) - step] * np.uint64(3) + mix(out[step:] + np.uint64(step)))
        have += step
    return out


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of a[i : i + width] for every i at which it fits."""
    if len(a) < width:
        return a[:0]
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each start, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep], counts[keep]
    at = np.cumsum(c)[:-1]
    step[0] = s[0]
    step[at] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(step)
