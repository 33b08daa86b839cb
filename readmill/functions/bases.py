"""Scalar column functions on bases, qualities and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of bases, and the lossy bins as (lower bound, representative).
BASE_ORDER = "AGCTNRWSKMDVHBYXU.-"
LOSSY_BINS = ((0, 0), (2, 6), (10, 15), (20, 22), (25, 27), (30, 33), (35, 37), (40, 40))
#: An ambiguous base moves into the quality stream below this score.
TRANSFER_BELOW = 7


def base_index(base: Column) -> Column:
    """0..18 in the fixed order; null for any other symbol, lower case included."""
    at = F.instr(F.lit(BASE_ORDER), base)
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def index_base(index: Column) -> Column:
    return F.when(index.between(0, len(BASE_ORDER) - 1), F.substring(F.lit(BASE_ORDER), index + 1, F.lit(1)))


def score(symbol: Column, offset: Column | int) -> Column:
    return F.ascii(symbol) - offset


def symbol(score_: Column, offset: Column | int) -> Column:
    return F.chr((score_ + offset).cast("long"))


def transferred(index: Column, q: Column) -> Column:
    """Quality code with an ambiguous low-quality base folded in."""
    return F.when((index > 3) & (q < TRANSFER_BELOW), q + 128 + (index - 4) * 8).otherwise(q)


def restored_index(code: Column) -> Column:
    """Index of a base that was folded into its quality code; null for plain codes."""
    return F.when(code >= 128, F.floor((code - 112) / 8).cast("int") + 2)


def restored_score(code: Column) -> Column:
    return F.when(code >= 128, code.bitwiseAND(7)).otherwise(code)


def lossy_bin(q: Column) -> Column:
    """Number of the bin of a score, 0..7."""
    out = F.lit(0)
    for k, (low, _) in enumerate(LOSSY_BINS):
        out = F.when(q >= low, k).otherwise(out) if k else out
    return F.when(q.between(0, 63), out)


def lossy_score(bin_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for _, v in LOSSY_BINS]), bin_ + 1)


def lossy_pair(index: Column, q: Column) -> tuple[Column, Column]:
    """(base, score) as they come back from lossy storage: N with 0 for ambiguous bases, at least 6 otherwise."""
    b = lossy_bin(q)
    return (
        F.when(index > 3, "N").otherwise(index_base(index)),
        F.when(index > 3, 0).otherwise(lossy_score(F.greatest(b, F.lit(1)))),
    )


def plus_line(tag: Column, repeated: Column | bool) -> Column:
    return F.when(F.lit(repeated) if isinstance(repeated, bool) else repeated, F.concat(F.lit("+"), F.substring(tag, 2, 1 << 30))).otherwise("+")


def record_bytes(tag: Column, sequence: Column, plus: Column, quality: Column) -> Column:
    return F.octet_length(tag) + F.octet_length(sequence) + F.octet_length(plus) + F.octet_length(quality) + 4


def fastq_text(tag: Column, sequence: Column, plus: Column, quality: Column) -> Column:
    """Four lines, null if a part is null; a title that lost its mark gets it back."""
    title = F.when(tag.startswith("@"), tag).otherwise(F.concat(F.lit("@"), tag))
    return F.concat(title, F.lit("\n"), sequence, F.lit("\n"), plus, F.lit("\n"), quality)


def valid_record(tag: Column, sequence: Column, plus: Column, quality: Column) -> Column:
    ok = tag.startswith("@") & (F.length(plus) > 0) & (F.length(sequence) == F.length(quality))
    return F.coalesce(ok, F.lit(False))


def position_context(pos: Column, length: Column, k: int) -> Column:
    """Which of k equal parts of a read a 1-based position lies in."""
    return F.floor((pos - 1) * k / length).cast("int")


def bit_length(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def offset_from_range(low: Column, high: Column) -> Column:
    """Quality offset from the smallest and largest code of a set; null if none can be right."""
    return (
        F.when((high > 74) & (high <= 105) & (low >= 64), 64)
        .when((high > 74) & (high <= 105) & (low >= 59), 59)
        .when(low >= 33, 33)
    )
