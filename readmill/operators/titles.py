"""Field statistics of record titles and the choice of their encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readmill.functions import bases as B
from readmill.functions import tags as T

#: Distinct values beyond which a histogram is given up.
HISTOGRAM_LIMIT = 512
#: Records per run from which runs are stored.
RUN_GAIN = 1.25


def templated(df: DataFrame) -> DataFrame:
    """Reads with a title: read_id, block_id, tag, the separators of their block's first title, the fields cut at them
    (null if the title lacks one), and whether the block is mixed, as some title does."""
    w = W.partitionBy("block_id")
    have = df.filter("tag is not null").select("read_id", "block_id", "tag").withColumn("template", T.separators(F.min_by("tag", "read_id").over(w)))
    cut = have.withColumn("fields", T.by_template(F.col("tag"), F.col("template")))
    return cut.withColumn("mixed", F.bool_or(F.col("fields").isNull()).over(w))


def title_fields(df: DataFrame) -> DataFrame:
    """(read_id, block_id, field_no, field_text, sep, num) of the title fields of blocks that are not mixed."""
    each = templated(df).filter("not mixed").select("read_id", "block_id", "template", F.posexplode("fields").alias("p0", "field_text"))
    return each.select(
        "read_id", "block_id", (F.col("p0") + 1).alias("field_no"), "field_text",
        F.coalesce(F.get("template", F.col("p0")), F.lit("")).alias("sep"), T.number(F.col("field_text")).alias("num"),
    )


def mixed_blocks(df: DataFrame) -> DataFrame:
    """(block_id, mixed, title_coder): a block is mixed if a title cannot be cut by the template of the first one."""
    return templated(df).groupBy("block_id").agg(F.bool_or("mixed").alias("mixed")).withColumn(
        "title_coder", F.when(F.col("mixed"), "raw").otherwise("tokenised")
    )


def field_stats(fields: DataFrame) -> DataFrame:
    """Per block and field: lengths, constancy, numeric flag, value range and number of distinct values."""
    return fields.groupBy("block_id", "field_no").agg(
        F.count("*").alias("n"),
        F.min(F.length("field_text")).alias("min_len"),
        F.max(F.length("field_text")).alias("max_len"),
        (F.min("field_text") == F.max("field_text")).alias("is_const"),
        F.bool_and(F.col("num").isNotNull()).alias("is_num"),
        F.min("num").alias("min_num"),
        F.max("num").alias("max_num"),
        F.count_distinct("num").alias("n_values"),
    )


def deltas(fields: DataFrame) -> DataFrame:
    w = W.partitionBy("block_id", "field_no").orderBy("read_id")
    return fields.withColumn("delta", F.col("num") - F.lag("num").over(w))


def kept_histograms(counts: DataFrame, value: str, limit: int = HISTOGRAM_LIMIT) -> DataFrame:
    """Of histograms per block and field (block_id, field_no, value, n), those with no more than `limit` distinct values."""
    size = counts.groupBy("block_id", "field_no").agg(F.count(value).alias("_k")).filter(F.col("_k") <= limit).drop("_k")
    return counts.join(size, ["block_id", "field_no"], "left_semi")


def value_histogram(fields: DataFrame) -> DataFrame:
    """(block_id, field_no, num, n) of fields that are numbers in the whole block, given up beyond the limit."""
    numeric = fields.groupBy("block_id", "field_no").agg(F.bool_and(F.col("num").isNotNull()).alias("_is")).filter("_is").drop("_is")
    counts = fields.filter("num is not null").groupBy("block_id", "field_no", "num").agg(F.count("*").alias("n"))
    return kept_histograms(counts.join(numeric, ["block_id", "field_no"], "left_semi"), "num")


def delta_histogram(fields: DataFrame) -> DataFrame:
    """(block_id, field_no, delta, n) of the steps between neighbouring records, given up beyond the limit."""
    return kept_histograms(deltas(fields).filter("delta is not null").groupBy("block_id", "field_no", "delta").agg(F.count("*").alias("n")), "delta")


#: A run is stored in pieces of one value and this many repeats.
REPEATS = 256


def number_scheme(fields: DataFrame) -> DataFrame:
    """Per numeric field: ranges, stored runs of values and of deltas, value or delta coding, the scheme, and if it has a Huffman code.

    A run is stored when another value follows, or at the end if it has repeats that are not stored yet; every 256 repeats are stored.
    """
    w = W.partitionBy("block_id", "field_no").orderBy("read_id")
    d = deltas(fields).withColumn("_k", F.row_number().over(w))
    d = d.withColumn("_second", F.lag("delta").over(w))
    d = d.withColumn("_new_v", (F.col("_k") == 1) | (F.col("delta") != 0)).withColumn("_new_d", (F.col("_k") == 2) | (F.col("_k") > 2) & (F.col("delta") != F.col("_second")))
    repeats = lambda new: F.col("_k") - F.max(F.when(F.col(new), F.col("_k"))).over(w)
    d = d.withColumn("_rv", repeats("_new_v")).withColumn("_rd", repeats("_new_d"))

    def stored(new: str, rep: str) -> Column:
        ends = F.sum(F.col(new).cast("long")) - 1
        full = F.sum(((F.col(rep) > 0) & (F.col(rep) % REPEATS == 0)).cast("long"))
        return F.greatest(ends + full + (F.max_by(rep, "_k") % REPEATS > 0).cast("long"), F.lit(0).cast("long"))

    s = d.groupBy("block_id", "field_no").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("num").isNotNull()).alias("is_num"),
        (F.max("num") - F.min("num")).alias("value_range"),
        (F.max("delta") - F.min("delta")).alias("delta_range"),
        stored("_new_v", "_rv").alias("value_runs"),
        stored("_new_d", "_rd").alias("delta_runs"),
        F.count_distinct("num").alias("n_values"),
        F.count_distinct("delta").alias("n_deltas"),
    ).filter("is_num and n > 1")
    gain = lambda c: (F.coalesce(F.try_divide(F.col("n").cast("float"), F.col(c).cast("float")), F.lit(1e30))).cast("float") > F.lit(RUN_GAIN).cast("float")
    by_value = F.col("value_range") < F.col("delta_range")
    scheme = (
        F.when(F.col("delta_range") == 0, "delta_const")
        .when(~by_value & gain("delta_runs"), "delta_rle")
        .when(gain("value_runs"), "value_rle")
        .when(~by_value, "delta_var")
        .otherwise("value_var")
    )
    kept = lambda range_, n: (F.col(range_) + 1 <= HISTOGRAM_LIMIT) & (F.col(n) <= HISTOGRAM_LIMIT)
    return s.withColumn("scheme", scheme).select(
        "block_id", "field_no", "value_range", "delta_range", "value_runs", "delta_runs",
        F.when(by_value, "value").otherwise("delta").alias("coding"), "scheme",
        F.when(F.col("scheme") == "value_var", kept("value_range", "n_values")).when(F.col("scheme") == "delta_var", kept("delta_range", "n_deltas")).otherwise(False).alias("huffman"),
        B.bit_length(F.when(by_value, F.col("value_range")).otherwise(F.col("delta_range"))).alias("coded_bits"),
        B.bit_length(F.col("value_range")).alias("value_bits"),
    )


def character_histogram(fields: DataFrame, limit: int = 128) -> DataFrame:
    """(block_id, field_no, pos, symbol, n); positions beyond the limit are pooled in the slot behind it."""
    chars = fields.filter("field_text <> ''").select("block_id", "field_no", F.posexplode(F.split("field_text", "")).alias("p0", "symbol"))
    return (
        chars.withColumn("pos", F.least(F.col("p0") + 1, F.lit(limit + 1)))
        .groupBy("block_id", "field_no", "pos", "symbol")
        .agg(F.count("*").alias("n"))
    )


def equal_positions(fields: DataFrame) -> DataFrame:
    """(block_id, field_no, pos, equal): positions at which all titles of a block have the same character."""
    per = fields.select("block_id", "field_no", F.length("field_text").alias("len"), "field_text")
    n = per.groupBy("block_id", "field_no").agg(F.count("*").alias("n"))
    chars = per.filter("field_text <> ''").select("block_id", "field_no", F.posexplode(F.split("field_text", "")).alias("p0", "c"))
    return (
        chars.groupBy("block_id", "field_no", (F.col("p0") + 1).alias("pos"))
        .agg(F.count("*").alias("have"), (F.min("c") == F.max("c")).alias("same"))
        .join(n, ["block_id", "field_no"])
        .select("block_id", "field_no", "pos", (F.col("same") & (F.col("have") == F.col("n"))).alias("equal"))
    )
