"""Queries of the core operators on the supplied tables, and the same in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readmill.functions import bases as B
from readmill.functions import tags as T
from readmill.operators import blocks, codecs, ordered, packed_fields, range_codec, rejects, titles, units
from readmill.plans.options import Options
from readmill.plans.runtime import load, new_folder, once_per_id
from readmill.sources import archive, fastq
from readmill.streaming import ingest


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "fastq_reads")


def _reads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Reads once each; texts go through an exchange, so operators with a narrow result per read use _narrow."""
    return blocks.reads(_raw(spark, d), *columns)


def _narrow(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    """(read_id, columns) of every read once: the columns are computed on the scan, only they are exchanged."""
    return once_per_id(_raw(spark, d).select("read_id", *(c.alias(k) for k, c in columns.items())))


def _offset_reads(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """Reads with one code per base and the offset of their run; once each, or as they are scanned."""
    df = _reads(spark, d, "block_id", "run_id", "sequence", "quality") if once else _raw(spark, d).select("read_id", "block_id", "run_id", "sequence", "quality")
    return blocks.with_offset(df, _raw(spark, d))


def _positions(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return blocks.positions(_reads(spark, d, "block_id", "run_id", "sequence", "quality"), *keep, raw=_raw(spark, d))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return blocks.with_transfer(_positions(spark, d))


def _parts() -> list[Column]:
    return [F.col(c) for c in ("tag", "sequence", "plus", "quality")]


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return titles.title_fields(_reads(spark, d, "block_id", "tag"))


#: Columns that come out as 64-bit numbers, by query.
LONG = {
    "block_stats": ("min_length", "max_length"), "quality_position_hist": ("pos",), "quality_position_hist_truncated": ("pos", "code"), "quality_hist": ("code",), "quality_runs": ("code",),
    "run_transitions": ("previous", "code"), "quality_context": ("part", "previous", "code"), "quality_context_k2": ("part", "code"), "quality_context_lossy_k3": ("part", "code"), "tag_field_stats": ("min_len", "max_len"),
    "tag_scheme": ("value_bits", "coded_bits"), "tag_length_range": ("min_len", "max_len"),
}


def _long(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(spark, d).withColumns({c: F.col(c).cast("long") for c in LONG[f.__name__]})

    return run if f.__name__ in LONG else f


# --- problems 2 to 4 ---------------------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = units.phred_sums(load(spark, d, "fastq_reads"), "read_id", "quality", "run_id", load(spark, d, "dataset"), 33)
    return out.select(F.col("id").alias("read_id"), "phred_sum")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = rejects.load_records(load(spark, d, "raw_records"), "raw_id", "raw_line")
    return out.filter("reason is not null").select(F.col("id").alias("raw_id"), "reason")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    out = rejects.load_records(load(spark, d, "raw_records"), "raw_id", "raw_line")
    return out.filter("reason is null").select(F.col("id").alias("raw_id"), *rejects.FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = packed_fields.split_values(
        load(spark, d, "fastq_reads"), "read_id", packed_fields.description(F.col("tag"))
    )
    return out.withColumnRenamed("id", "read_id")


# --- reads and datasets ------------------------------------------------------------------------


def reads_scan(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d)


def quality_offset_infer(spark: SparkSession, d: str) -> DataFrame:
    return blocks.dataset_type(_raw(spark, d))


def record_validity(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, run_id=F.col("run_id"), valid=B.valid_record(*_parts())).groupBy("run_id", "valid").agg(F.count("*").alias("n"))


def plus_regenerate(spark: SparkSession, d: str) -> DataFrame:
    line = B.plus_line(F.col("tag"), F.coalesce(F.length("plus") > 1, F.lit(False)))
    return _narrow(spark, d, plus_line=F.when(F.col("tag").isNotNull(), line)).filter("plus_line is not null")


def fastq_text(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "tag", "sequence", "plus", "quality").select(
        "read_id", B.fastq_text(F.col("tag"), F.col("sequence"), F.col("plus"), F.col("quality")).alias("record_text")
    )


def record_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, rec_bytes=B.record_bytes(*_parts()).cast("long"))


def block_assemble(spark: SparkSession, d: str) -> DataFrame:
    r = _narrow(spark, d, run_id=F.col("run_id"), rec_bytes=B.record_bytes(*_parts()))
    out = ordered.assemble(r.filter("rec_bytes is not null"), 65536, "run_id")
    return out.groupBy("run_id", "part").agg(F.count("*").alias("n"), F.sum("rec_bytes").alias("part_bytes"))


def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    return fastq.chunk_rows(load(spark, d, "fastq_chunks"), "chunk_id", "chunk_text")


def _chunk_files(spark: SparkSession, d: str, lost_line: int | None = None) -> str:
    """The chunks as FASTQ files in the shared folder, each without one of its lines if given."""
    at = new_folder(spark, "fastq")
    text = F.regexp_replace("chunk_text", "\r?\n$", "")
    if lost_line is not None:
        text = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: i != lost_line), "\n")
    load(spark, d, "fastq_chunks").filter("chunk_text is not null").select(text.alias("value")).write.text(at)
    return at


def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    """The chunks as files, scanned in small splits."""
    return fastq.read_fastq(spark, _chunk_files(spark, d), 1 << 18).select("tag", "sequence", "plus", "quality", "valid")


def fastq_scan_damaged(spark: SparkSession, d: str) -> DataFrame:
    """As fastq_scan, with the quality line of the third record of each chunk lost."""
    return fastq.read_fastq(spark, _chunk_files(spark, d, 11), 1 << 18).select("tag", "sequence", "plus", "quality", "valid")


def fastq_stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """As fastq_scan, the files as a stream that is worked off once."""
    out = new_folder(spark, "stream")
    ingest.run_available(ingest.fastq_stream(spark, _chunk_files(spark, d), split_bytes=1 << 18), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("tag", "sequence", "plus", "quality", "valid")


def _whole_reads(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "tag", "sequence", "plus", "quality").filter(B.valid_record(*_parts()))


def fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All valid reads written as FASTQ text in order and scanned again."""
    at = new_folder(spark, "fastq")
    fastq.write_fastq(_whole_reads(spark, d), at)
    return fastq.read_fastq(spark, at, 1 << 20).select("tag", "sequence", "plus", "quality", "valid")


def archive_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reads that make one consistent dataset (bases, plain plus lines) through an archive with checksums, which are verified."""
    at = new_folder(spark, "archive")
    one = _whole_reads(spark, d).filter("plus = '+' and not sequence rlike '^.[0-3.]'")
    archive.write_archive(one, at, Options(crc32=True, buffer_mb=1, quality_offset=33))
    bad = archive.corrupt_blocks(spark, at).count()
    return archive.read_archive(spark, at).select("read_id", "tag", "sequence", "plus", "quality", F.lit(bad).alias("corrupt_blocks"))


def stream_sizes(spark: SparkSession, d: str) -> DataFrame:
    names = ("tag", "sequence", "quality")
    return _narrow(spark, d, run_id=F.col("run_id"), **{c: F.octet_length(c) for c in names}).groupBy("run_id").agg(
        *(F.sum(c).alias(f"{c}_bytes") for c in names)
    )


# --- blocks ------------------------------------------------------------------------------------


def block_stats(spark: SparkSession, d: str) -> DataFrame:
    r = _narrow(
        spark, d, block_id=F.col("block_id"), size=B.record_bytes(*_parts()), length=F.length("quality"), first=F.substring("sequence", 1, 1)
    )
    same = F.min("first") == F.max("first")
    return r.groupBy("block_id").agg(
        F.count("*").alias("n_records"),
        F.sum("size").alias("size_bytes"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        (F.min("length") != F.max("length")).alias("variable_length"),
        same.alias("primer_const"),
        F.when(same, F.min("first")).alias("primer_base"),
    )


def block_meta_check(spark: SparkSession, d: str) -> DataFrame:
    """Recorded block headers against the reads that are there."""
    seen = _narrow(spark, d, block_id=F.col("block_id"), length=F.length("quality")).groupBy("block_id").agg(
        F.count("*").alias("n_seen"), F.min("length").alias("min_seen"), F.max("length").alias("max_seen")
    )
    m = load(spark, d, "block_meta").select("block_id", "records_count", "min_len", "max_len")
    return m.join(seen, "block_id", "left").select(
        "block_id", "records_count", F.coalesce("n_seen", F.lit(0)).cast("long").alias("n_seen"),
        (F.coalesce("n_seen", F.lit(0)) - F.col("records_count")).cast("long").alias("n_missing"),
        (F.col("min_len").eqNullSafe(F.col("min_seen")) & F.col("max_len").eqNullSafe(F.col("max_seen"))).alias("lengths_agree"),
    )


def _joined(column: str):
    return F.expr(f"listagg({column}, '') within group (order by read_id)")


def block_digest(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "block_id", "tag", "sequence", "quality").groupBy("block_id").agg(
        *(F.md5(F.coalesce(_joined(c), F.lit(""))).alias(f"{c}_md5") for c in ("tag", "sequence", "quality"))
    )


def block_crc(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of the three streams of a block in order; without an SQL twin, DuckDB has no CRC."""
    return _reads(spark, d, "block_id", "tag", "sequence", "quality").groupBy("block_id").agg(
        *(F.crc32(F.coalesce(_joined(c), F.lit("")).cast("binary")).alias(f"{c}_crc") for c in ("tag", "sequence", "quality"))
    )


# --- bases and qualities -----------------------------------------------------------------------


def quality_position_hist(spark: SparkSession, d: str) -> DataFrame:
    return blocks.histogram(_positions(spark, d), ["block_id", "pos", "q"])


def quality_position_hist_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Codes by place over the part of each read before its tail of 2s."""
    return blocks.histogram(blocks.truncated_positions(_offset_reads(spark, d)), ["block_id", "pos", "code"])


def quality_hist(spark: SparkSession, d: str) -> DataFrame:
    return blocks.histogram(_codes(spark, d), ["block_id", "code"])


def base_hist(spark: SparkSession, d: str) -> DataFrame:
    return blocks.histogram(_codes(spark, d).filter("kept"), ["block_id", "base"])


def base_hist_rollup(spark: SparkSession, d: str) -> DataFrame:
    return (
        _positions(spark, d, "run_id").rollup("run_id", "base")
        .agg(F.count("*").alias("n"), (F.grouping("run_id") * 2 + F.grouping("base")).cast("long").alias("level"))
    )


def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    each = _codes(spark, d).filter("kept and idx is not null").select("block_id", "base", "idx").distinct()
    w = W.partitionBy("block_id")
    return each.select(
        "block_id", "base", (F.dense_rank().over(w.orderBy("idx")) - 1).cast("long").alias("dense"), F.count("*").over(w).alias("n_symbols")
    )


def dna_scheme(spark: SparkSession, d: str) -> DataFrame:
    n = _codes(spark, d).filter("kept").groupBy("block_id").agg(F.count_distinct("base").alias("n_symbols"))
    return n.select("block_id", "n_symbols", *(B_.alias(f"order_{k}") for k, B_ in ((k, blocks.base_scheme(F.col("n_symbols"), k)) for k in (0, 3, 9))))


def iupac_index(spark: SparkSession, d: str) -> DataFrame:
    idx = B.base_index(F.col("base"))
    return _positions(spark, d).select("base", idx.cast("long").alias("idx")).groupBy("base", "idx").agg(F.count("*").alias("n")).withColumn(
        "back", B.index_base(F.col("idx").cast("int"))
    )


def lossy_bin(spark: SparkSession, d: str) -> DataFrame:
    b = B.lossy_bin(F.col("q"))
    return _positions(spark, d).groupBy("q").agg(F.count("*").alias("n")).select(
        "q", "n", b.alias("bin"), B.lossy_score(b).alias("stored")
    )


def lossy_reads(spark: SparkSession, d: str) -> DataFrame:
    return once_per_id(blocks.lossy_texts(_offset_reads(spark, d, once=False)).select("read_id", "lossy_sequence", "lossy_quality"))


def ambiguity_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).groupBy("block_id").agg(
        F.count("*").alias("n"), F.sum((~F.col("kept")).cast("long")).alias("n_moved"), F.sum("code").alias("code_sum")
    )


def ambiguity_restore(spark: SparkSession, d: str) -> DataFrame:
    c = _codes(spark, d).filter("idx is not null")
    same = (F.coalesce(B.restored_index(F.col("code")), F.col("idx")) == F.col("idx")) & (B.restored_score(F.col("code")) == F.col("q"))
    return c.filter("not kept").groupBy("base", "q").agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("n_restored"))


def truncated_len(spark: SparkSession, d: str) -> DataFrame:
    r = blocks.read_lengths(_offset_reads(spark, d, once=False))
    return once_per_id(r.select("read_id", F.col("cut").cast("long").alias("truncated_length"), F.col("raw").cast("long").alias("full_length")))


def quality_scheme(spark: SparkSession, d: str) -> DataFrame:
    return blocks.quality_lengths(_offset_reads(spark, d, once=False))


def quality_model(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the lossless order-k quality model (least of 16, 32, 64, 128 that holds all codes) and its kind.

    Reads of one length whose qualities run on use the run-aware kind.
    """
    c = _codes(spark, d)
    n = c.groupBy("block_id").agg(F.count_distinct("code").alias("n_codes"), (F.min("n") == F.max("n")).alias("_same"))
    size = F.when(F.col("n_codes") <= 16, 16).when(F.col("n_codes") <= 32, 32).when(F.col("n_codes") <= 64, 64).otherwise(128)
    long_runs = F.coalesce(F.try_divide(F.col("raw_len"), F.col("rle_len")) > 1.175, F.lit(True))
    return n.join(quality_scheme(spark, d), "block_id").select(
        "block_id", "n_codes", size.alias("model"), F.when(F.col("_same") & long_runs, "positional").otherwise("normal").alias("kind")
    )


def quality_runs(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.runs(_codes(spark, d), ["block_id"], ["read_id", "pos"], "code", 255)
    return out.groupBy("block_id", "code", "piece_length").agg(F.count("*").alias("n"))


def run_transitions(spark: SparkSession, d: str) -> DataFrame:
    return ordered.transitions(ordered.runs(_codes(spark, d), ["block_id"], ["read_id", "pos"], "code", 255), ["block_id"], "code")


def run_sets(spark: SparkSession, d: str) -> DataFrame:
    """Run symbols and run lengths that occur in a block, each with its dense index."""
    p = ordered.runs(_codes(spark, d), ["block_id"], ["read_id", "pos"], "code", 255)
    kinds = p.select("block_id", F.explode(F.map_from_arrays(F.array(F.lit("symbol"), F.lit("length")), F.array(F.col("code").cast("long"), "piece_length"))).alias("kind", "value")).distinct()
    w = W.partitionBy("block_id", "kind").orderBy("value")
    return kinds.withColumn("dense", (F.row_number().over(w) - 1).cast("long"))


def run_expand(spark: SparkSession, d: str) -> DataFrame:
    pieces = ordered.runs(_codes(spark, d), ["block_id"], ["read_id", "pos"], "code", 255)
    return ordered.expand(pieces, ["block_id"], "code").groupBy("block_id").agg(
        F.count("*").alias("n"), F.sum(F.col("ordinal") * F.col("code")).alias("weighted")
    )


def dna_context_k1(spark: SparkSession, d: str) -> DataFrame:
    return blocks.context_counts(_offset_reads(spark, d), 1)


def dna_context_k3(spark: SparkSession, d: str) -> DataFrame:
    return blocks.context_counts(_offset_reads(spark, d), 3)


def dna_context_k9(spark: SparkSession, d: str) -> DataFrame:
    return blocks.context_counts(_offset_reads(spark, d), 9)


def dna_entropy_k3(spark: SparkSession, d: str) -> DataFrame:
    return blocks.entropy_bits(dna_context_k3(spark, d), ["block_id", "context"])


def quality_entropy(spark: SparkSession, d: str) -> DataFrame:
    return blocks.entropy_bits(blocks.histogram(_codes(spark, d), ["block_id", "pos", "code"]), ["block_id", "pos"])


def quality_context(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a quality code by the code before it and the eighth of the read it lies in."""
    return blocks.quality_contexts(_offset_reads(spark, d), 1).select("part", F.col("context").cast("int").alias("previous"), "code", "n")


def quality_context_k2(spark: SparkSession, d: str) -> DataFrame:
    return blocks.quality_contexts(_offset_reads(spark, d), 2)


def quality_context_lossy_k3(spark: SparkSession, d: str) -> DataFrame:
    return blocks.quality_contexts(_offset_reads(spark, d), 3, lossy=True)


def _codable(spark: SparkSession, d: str) -> DataFrame:
    r = blocks.one_code_per_base(_reads(spark, d, "block_id", "run_id", "tag", "sequence", "quality"))
    kind = quality_offset_infer(spark, d).select("run_id", F.col("quality_offset").alias("offset")).filter("offset is not null")
    return r.filter(F.col("tag").isNotNull() & F.col("sequence").rlike(rf"^[{B.BASE_ORDER}]+$")).join(kind, "run_id")


def block_codec(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the coded streams of each block with their round trip; without an SQL twin, the codes are built step by step."""
    return codecs.coded_sizes(_codable(spark, d))


def block_codec_k3(spark: SparkSession, d: str) -> DataFrame:
    """Bases coded by order 3 and qualities by order 1; without an SQL twin, the models adapt symbol by symbol."""
    return range_codec.order_coded_sizes(_codable(spark, d), 3, 1)


def block_codec_k9(spark: SparkSession, d: str) -> DataFrame:
    """Bases coded by order 9 and qualities by order 2."""
    return range_codec.order_coded_sizes(_codable(spark, d), 9, 2)


def block_codec_lossy_k3(spark: SparkSession, d: str) -> DataFrame:
    """Lossy symbols of the qualities coded by order 3, bases by order 6."""
    return range_codec.order_coded_sizes(_codable(spark, d), 6, 3, lossy=True)


# --- colour space ------------------------------------------------------------------------------


def _colour_reads(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "run_id", "sequence").filter(F.col("sequence").rlike("^[ACGT][0-3.]+$"))


def colorspace_decode(spark: SparkSession, d: str) -> DataFrame:
    return ordered.colours_to_bases(_colour_reads(spark, d), "sequence").select("read_id", "bases")


def colorspace_encode(spark: SparkSession, d: str) -> DataFrame:
    there = ordered.colours_to_bases(_colour_reads(spark, d), "sequence")
    back = ordered.bases_to_colours(there, "bases")
    return back.select("read_id", "colours", (F.col("colours") == F.col("sequence")).alias("same"))


def primer_strip(spark: SparkSession, d: str) -> DataFrame:
    """Reads of blocks whose first symbol is constant, without it; the block keeps the symbol."""
    r = _reads(spark, d, "block_id", "sequence").filter("sequence <> ''")
    first = F.substring("sequence", 1, 1)
    b = r.groupBy("block_id").agg(F.min(first).alias("primer"), F.max(first).alias("_m")).filter("primer = _m").drop("_m")
    return r.join(b, "block_id").select("read_id", "primer", F.substring("sequence", 2, 1 << 30).alias("rest"))


# --- titles ------------------------------------------------------------------------------------


def tag_fields(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("read_id", F.col("field_no").cast("long").alias("field_no"), "field_text", "sep", "num")


def tag_project(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, projected=T.project(F.col("tag"), [1, 3]))


def tag_mixed(spark: SparkSession, d: str) -> DataFrame:
    return titles.mixed_blocks(_reads(spark, d, "block_id", "tag"))


def tag_field_stats(spark: SparkSession, d: str) -> DataFrame:
    return titles.field_stats(_fields(spark, d)).withColumn("field_no", F.col("field_no").cast("long"))


def tag_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of each block and field without the limit of the histograms."""
    return titles.deltas(_fields(spark, d)).filter("delta is not null").groupBy("block_id", F.col("field_no").cast("long").alias("field_no"), "delta").agg(F.count("*").alias("n"))


def tag_value_hist(spark: SparkSession, d: str) -> DataFrame:
    return titles.value_histogram(_fields(spark, d)).withColumn("field_no", F.col("field_no").cast("long"))


def tag_delta_hist(spark: SparkSession, d: str) -> DataFrame:
    return titles.delta_histogram(_fields(spark, d)).withColumn("field_no", F.col("field_no").cast("long"))


def tag_length_range(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d, block_id=F.col("block_id"), length=F.length("tag")).groupBy("block_id").agg(
        F.min("length").alias("min_len"), F.max("length").alias("max_len")
    )


def tag_runs(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.runs(_fields(spark, d).filter("num is not null"), ["block_id", "field_no"], ["read_id"], "num", 256)
    return out.groupBy("block_id", F.col("field_no").cast("long").alias("field_no"), "piece_length").agg(F.count("*").alias("n"))


def tag_delta_runs(spark: SparkSession, d: str) -> DataFrame:
    steps = titles.deltas(_fields(spark, d)).filter("delta is not null")
    out = ordered.runs(steps, ["block_id", "field_no"], ["read_id"], "delta", 256)
    return out.groupBy("block_id", F.col("field_no").cast("long").alias("field_no"), "piece_length").agg(F.count("*").alias("n"))


def tag_scheme(spark: SparkSession, d: str) -> DataFrame:
    return titles.number_scheme(_fields(spark, d)).withColumn("field_no", F.col("field_no").cast("long"))


def tag_char_hist(spark: SparkSession, d: str) -> DataFrame:
    return titles.character_histogram(_fields(spark, d)).select("block_id", F.col("field_no").cast("long").alias("field_no"), F.col("pos").cast("long").alias("pos"), "symbol", "n")


def tag_ham_mask(spark: SparkSession, d: str) -> DataFrame:
    return titles.equal_positions(_fields(spark, d)).select("block_id", F.col("field_no").cast("long").alias("field_no"), F.col("pos").cast("long").alias("pos"), "equal")


def tag_symbol_hist(spark: SparkSession, d: str) -> DataFrame:
    each = _reads(spark, d, "block_id", "tag").filter("tag <> ''").select("block_id", F.explode(F.split("tag", "")).alias("symbol"))
    return each.groupBy("block_id", "symbol").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: _long(f)
        for f in (
            p2_found, p3_found, p3_records, p4_found,
            reads_scan, quality_offset_infer, record_validity, plus_regenerate, fastq_text, record_bytes, block_assemble,
            chunk_records, fastq_scan, fastq_scan_damaged, fastq_stream_scan, fastq_round_trip, archive_round_trip, stream_sizes, block_stats, block_meta_check, block_digest, block_crc,
            quality_position_hist, quality_position_hist_truncated, quality_hist, base_hist, base_hist_rollup, symbol_index, dna_scheme, iupac_index, lossy_bin,
            lossy_reads, ambiguity_transfer, ambiguity_restore, truncated_len, quality_scheme, quality_model, quality_runs,
            run_transitions, run_sets, run_expand, dna_context_k1, dna_context_k3, dna_context_k9, dna_entropy_k3, quality_entropy, quality_context,
            quality_context_k2, quality_context_lossy_k3, block_codec, block_codec_k3, block_codec_k9, block_codec_lossy_k3,
            colorspace_decode, colorspace_encode, primer_strip,
            tag_fields, tag_project, tag_mixed, tag_field_stats, tag_deltas, tag_value_hist, tag_delta_hist, tag_length_range, tag_runs, tag_delta_runs, tag_scheme, tag_char_hist, tag_ham_mask,
            tag_symbol_hist,
        )
    }


def oracle_sql() -> dict[str, str]:
    from readmill.oracles import SQL

    return SQL
