"""Positions of reads and per-block statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readmill.functions import bases as B
from readmill.plans.runtime import once_per_id

READ_COLUMNS = ("read_id", "block_id", "run_id", "tag", "sequence", "plus", "quality")


def reads(raw: DataFrame, *columns: str) -> DataFrame:
    """Reads once per read_id with the given columns only, so that the scan is pruned to them."""
    cols = [c for c in READ_COLUMNS if not columns or c in columns or c == "read_id"]
    return once_per_id(raw.select(*cols), "read_id")


def one_code_per_base(df: DataFrame) -> DataFrame:
    return df.filter(F.length("sequence") == F.length("quality"))


def code_ends(quality: Column) -> tuple[Column, Column]:
    """Smallest and largest code of a quality text."""
    chars = F.split(quality, "")
    return F.ascii(F.array_min(chars)), F.ascii(F.array_max(chars))


def dataset_type(raw: DataFrame, by: str = "run_id") -> DataFrame:
    """Inference per dataset: range of the codes, offset, colour space, repeated titles, consistency, usable.

    raw may hold reads again: what a read adds is made narrow first, then each read counts once.
    """
    low, high = code_ends(F.col("quality"))
    own = one_code_per_base(raw).filter("sequence <> ''").select(
        "read_id", by, low.alias("_low"), high.alias("_high"),
        F.substring("sequence", 2, 1).rlike("^[0-3.]$").alias("_second"), F.substring("sequence", 1, 1).rlike("^[0-3]$").alias("_digit"),
        (F.length("plus") > 1).alias("_rep"),
    )
    rep, second = F.col("_rep"), F.col("_second")
    return once_per_id(own).groupBy(by).agg(
        F.count("*").alias("n_records"),
        F.min("_low").alias("min_code"),
        F.max("_high").alias("max_code"),
        F.bool_and(second & ~F.col("_digit")).alias("color_space"),
        F.bool_and(rep).alias("plus_repetition"),
        ((F.bool_and(rep) == F.bool_or(rep)) & (F.bool_and(second) == F.bool_or(second))).alias("consistent"),
    ).withColumn("quality_offset", B.offset_from_range(F.col("min_code"), F.col("max_code"))).withColumn(
        "usable", F.col("consistent") & (F.col("n_records") > 1) & F.col("quality_offset").isNotNull()
    )


def with_offset(df: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Reads with one quality character per base and the `offset` of their run, inferred from the codes of raw (df itself if not given).

    A range is the same with repeated reads, so it is taken from the scan without an exchange of texts.
    """
    low, high = code_ends(F.col("quality"))
    offsets = one_code_per_base(df if raw is None else raw).filter("quality <> ''").groupBy("run_id").agg(
        B.offset_from_range(F.min(low), F.max(high)).alias("offset")
    )
    return one_code_per_base(df).filter("sequence <> ''").join(offsets, "run_id")


def positions(df: DataFrame, *keep: str, raw: DataFrame | None = None) -> DataFrame:
    """One row per base: read_id, block_id, pos (1-based), base, q in the unit of the run, and the kept columns.

    Only reads with one quality character per base have positions; see with_offset.
    """
    both = F.arrays_zip(F.split("sequence", "").alias("base"), F.split("quality", "").alias("code"))
    return (
        with_offset(df, raw)
        .select("read_id", "block_id", *keep, "offset", F.length("sequence").alias("n"), F.posexplode(both).alias("p0", "x"))
        .select(
            "read_id", "block_id", *keep, "n", (F.col("p0") + 1).alias("pos"), F.col("x.base").alias("base"),
            B.score(F.col("x.code"), F.col("offset")).alias("q"),
        )
    )


def plain_reads(df: DataFrame) -> Column:
    """True for reads of A, G, C and T only with a known offset: their codes are their qualities, so texts can be worked on as a whole."""
    return F.coalesce(~F.col("sequence").rlike("[^AGCT]") & F.col("offset").isNotNull(), F.lit(False))


def _codes() -> Column:
    """The quality codes of a read after the ambiguity transfer, as an array."""
    return F.zip_with(F.split("sequence", ""), F.split("quality", ""), lambda b, c: B.transferred(B.base_index(b), B.score(c, F.col("offset"))))


def read_lengths(df: DataFrame) -> DataFrame:
    """Reads with an offset, and per read: raw (number of codes), cut (place of the last code that is not 2, at least 1), runs, last (its last code)."""
    plain, quality = plain_reads(df), F.col("quality")
    codes = F.when(~plain, _codes())
    n = F.size(codes)
    turns = F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: F.coalesce(a != b, F.lit(True)).cast("int"))
    cut = F.coalesce(F.array_max(F.transform(codes, lambda c, i: F.when(c != 2, i + 1))), F.lit(1))
    tail = F.chr((F.col("offset") + 2).cast("long"))
    return df.select(
        "*", F.length("quality").alias("raw"),
        F.when(plain, F.greatest(F.length(F.rtrim(quality, tail)), F.lit(1))).otherwise(cut).alias("cut"),
        F.when(plain, F.length(F.regexp_replace(quality, r"(.)\1+", "$1"))).otherwise(F.aggregate(turns, F.lit(1), lambda t, x: t + x)).alias("runs"),
        F.when(plain, B.score(F.substring(quality, -1, 1), F.col("offset"))).otherwise(F.element_at(codes, -1)).alias("last"),
    )


def truncated_positions(df: DataFrame) -> DataFrame:
    """(block_id, read_id, pos, code) of the places of each read up to its last code that is not 2; df: reads with an offset, once each."""
    both = F.arrays_zip(F.split("sequence", "").alias("b"), F.split("quality", "").alias("c"))
    each = read_lengths(df).select("block_id", "read_id", "offset", F.posexplode(F.slice(both, F.lit(1), F.col("cut"))).alias("p0", "x"))
    code = B.transferred(B.base_index(F.col("x.b")), B.score(F.col("x.c"), F.col("offset")))
    return each.select("block_id", "read_id", (F.col("p0") + 1).alias("pos"), code.alias("code"))


def lossy_texts(df: DataFrame, to_offset: int = 33) -> DataFrame:
    """Reads with an offset as they come back from lossy storage: lossy_sequence, lossy_quality (in characters from to_offset on)."""
    both = F.arrays_zip(F.split("sequence", "").alias("b"), F.split("quality", "").alias("c"))
    ambiguous = lambda x: B.base_index(x["b"]) > 3
    stored = lambda q: B.lossy_score(F.greatest(B.lossy_bin(q), F.lit(1)))
    seq = F.array_join(F.transform(both, lambda x: F.when(ambiguous(x), "N").otherwise(B.index_base(B.base_index(x["b"])))), "")
    qual = F.array_join(F.transform(both, lambda x: B.symbol(F.when(ambiguous(x), 0).otherwise(stored(B.score(x["c"], F.col("offset")))), to_offset)), "")
    whole, plain = F.lit(None).cast("string"), plain_reads(df)
    for o in (33, 59, 64):
        fits = plain & (F.col("offset") == o) & F.col("quality").rlike(rf"^[\x{o:02x}-\x{o + 63:02x}]*$")
        to = [max((v for low, v in B.LOSSY_BINS if low <= max(q, 2))) for q in range(64)]
        whole = F.when(fits, F.translate("quality", "".join(map(chr, range(o, o + 64))), "".join(chr(to_offset + v) for v in to))).otherwise(whole)
    out = df.withColumn("_whole", whole)
    return out.select(
        *df.columns, F.when(F.col("_whole").isNotNull(), F.col("sequence")).otherwise(seq).alias("lossy_sequence"),
        F.coalesce("_whole", qual).alias("lossy_quality"),
    )


def with_transfer(pos: DataFrame) -> DataFrame:
    """Adds the base's index and the quality code after the ambiguity transfer; `kept` says if the base stays."""
    idx = B.base_index(F.col("base"))
    code = B.transferred(idx, F.col("q"))
    return pos.withColumn("idx", idx).withColumn("code", code).withColumn("kept", code < 128)


def histogram(df: DataFrame, keys: Iterable[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def quality_lengths(df: DataFrame) -> DataFrame:
    """Per block: number of codes, of codes before the tail of 2s, of runs within reads; and the chosen scheme.

    df: reads with an offset; one that is there again counts once.  The numbers of a read come from its texts, only they are exchanged.
    """
    per_read = once_per_id(read_lengths(df).select("read_id", "block_id", "raw", "cut", "runs", "last"))
    out = per_read.groupBy("block_id").agg(
        F.sum("raw").alias("raw_len"),
        F.sum(F.col("cut") - 1).alias("th_len"),
        (F.sum("runs") - F.sum((F.col("last") == 2).cast("int"))).alias("rle_len"),
    )
    # no tail and no runs at all: an empty denominator means "larger than any bound"
    th, rle, raw = (F.col(c).cast("float") for c in ("th_len", "rle_len", "raw_len"))
    scheme = (
        F.when(F.coalesce(F.try_divide(th, rle), F.when(th > 0, 1e30).otherwise(0.0)).cast("float") > F.lit(1.25).cast("float"), "rle")
        .when(F.coalesce(F.try_divide(raw, th), F.lit(1e30)).cast("float") > F.lit(1.10).cast("float"), "truncated")
        .otherwise("plain")
    )
    return out.withColumn("scheme", scheme)


def context_counts(df: DataFrame, k: int) -> DataFrame:
    """(block_id, context, base, n): order-k base contexts over the bases that stay in a block, across its reads; before the first base stand As.

    df: reads with an offset.  The bases that stay are put together per read and then per block, so no row per base is exchanged.
    """
    stays = F.zip_with(
        F.split("sequence", ""), F.split("quality", ""),
        lambda b, c: F.when(B.transferred(B.base_index(b), B.score(c, F.col("offset"))) < 128, b),
    )
    kept = df.select("read_id", "block_id", F.array_join(F.filter(stays, lambda b: B.base_index(b).isNotNull()), "").alias("kept"))
    line = kept.groupBy("block_id").agg(F.expr("listagg(kept, '') within group (order by read_id)").alias("line"))
    # a place in bytes is found at once, one in characters only by going through the text
    padded = line.filter("line <> ''").withColumn("bytes", F.concat(F.lit("A" * k), F.col("line")).cast("binary"))
    words = F.transform(F.sequence(F.lit(1), F.length("line")), lambda i: F.substring("bytes", i, F.lit(k + 1)))
    each = padded.select("block_id", F.explode(words).alias("word")).select("block_id", F.col("word").cast("string").alias("word"))
    return histogram(each.select("block_id", F.substring("word", 1, k).alias("context"), F.substring("word", k + 1, 1).alias("base")), ["block_id", "context", "base"])


def quality_contexts(df: DataFrame, order: int, parts: int = 8, lossy: bool = False) -> DataFrame:
    """(part, context, code, n): counts of a code by the `order` codes before it in its read, joined by commas, and its part of the read.

    df: reads with an offset.  Before the first code stand 0s.  `lossy` counts the 8 symbols of lossy storage in place of the codes: 0 for an
    ambiguous base, 1 to 7 otherwise.  The contexts of a read come from its array and are counted before anything is exchanged.
    """
    def symbol(b: Column, c: Column) -> Column:
        q, idx = B.score(c, F.col("offset")), B.base_index(b)
        code = F.when(idx > 3, 0).otherwise(F.greatest(B.lossy_bin(q), F.lit(1))) if lossy else B.transferred(idx, q)
        return code.cast("int")

    codes = df.select(F.zip_with(F.split("sequence", ""), F.split("quality", ""), symbol).alias("codes"), F.length("sequence").alias("n"))
    words = F.concat(F.array_repeat(F.lit(0), order), F.col("codes"))
    each = codes.withColumn("words", words.cast("array<string>")).select("n", "words", F.posexplode("codes").alias("p0", "code"))
    context = F.array_join(F.slice("words", F.col("p0") + 1, order), ",")
    part = B.position_context(F.col("p0") + 1, F.col("n"), parts)
    return histogram(each.select(part.alias("part"), context.alias("context"), "code"), ["part", "context", "code"])


def entropy_bits(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Ideal size in bits of a stream coded with its own static statistics, per first key."""
    total = F.sum(n).over(W.partitionBy(*keys))
    return (
        counts.withColumn("_t", total)
        .groupBy(keys[0])
        .agg(F.round(F.sum(-F.col(n) * F.log2(F.col(n) / F.col("_t"))), 3).alias("bits"), F.sum(n).alias("symbols"))
    )


def base_scheme(n_symbols: Column, order: int) -> Column:
    if order == 0:
        return F.when(n_symbols == 0, "none").when(n_symbols <= 4, "bits2").otherwise("huffman")
    return (
        F.when(n_symbols == 0, "none")
        .when(n_symbols <= 4, f"order{order}_4")
        .otherwise(f"order{min(order, 7)}_8")
    )
