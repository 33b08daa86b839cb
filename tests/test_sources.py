import os
import random

import pytest
from pyspark.sql import functions as F

from readmill.plans.options import Options
from readmill.sources import archive
from readmill.sources import fastq
from readmill.sources.fastq import chunk_rows, read_fastq, write_fastq

R = random.Random(9)


def records(n, eol="\n", plus=False):
    out = []
    for i in range(n):
        size = R.randrange(1, 60)
        seq = "".join(R.choice("ACGTN") for _ in range(size))
        qual = R.choice("@+I") + "".join(chr(R.randrange(33, 74)) for _ in range(size - 1))
        tag = f"@R.{i} x:{i // 3}"
        out.append((tag, seq, "+" + tag[1:] if plus else "+", qual))
    return out, eol.join(x for r in out for x in r) + eol


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_every_split_gives_the_same_rows(spark, tmp_path, eol):
    want, text = records(120, eol)
    (tmp_path / "a.fastq").write_bytes(text.encode()[: -len(eol)])
    (tmp_path / "b.fastq").write_bytes(b"")
    for split in (37, 100, 999, 1 << 20):
        got = read_fastq(spark, str(tmp_path), split).orderBy("read_id").collect()
        assert [(r.tag, r.sequence, r.plus, r.quality) for r in got] == want
        assert all(r.valid for r in got)


def test_malformed_records_are_kept(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nAC\n+\nI\n@b\nAC\n+\nII\n@c\nAC\n")
    got = read_fastq(spark, str(tmp_path)).orderBy("read_id").collect()
    assert [(r.tag, r.valid) for r in got] == [("@a", False), ("@b", True), ("@c", False)]


def rows_of(path, split):
    reader = fastq.FastqReader({"path": path, "splitBytes": split})
    return sorted(tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())


def test_a_damaged_record_does_not_touch_the_others(spark, tmp_path):
    want, text = records(200)
    lines = text.split("\n")
    size = len(lines[4 * 50 + 1])
    lines[4 * 51] = "@" + "t" * (size + 5)  # the next title is longer than the sequence: it cannot be its quality
    want[51] = (lines[4 * 51], *want[51][1:])
    text = "\n".join(x for i, x in enumerate(lines) if i != 4 * 50 + 3)
    (tmp_path / "a.fastq").write_text(text)
    for split in (300, 1000, 1 << 20):
        got = read_fastq(spark, str(tmp_path), split).orderBy("read_id").collect()
        assert [(r.tag, r.sequence, r.plus, r.quality) for r in got if r.valid] == want[:50] + want[51:]
        assert [(r.tag, r.sequence, r.plus, r.quality) for r in got if not r.valid] == [(*want[50][:3], None)]


@pytest.mark.parametrize("peek", [1024, 1 << 16])
def test_damaged_files_give_the_same_rows_for_every_split(tmp_path, monkeypatch, peek):
    monkeypatch.setattr(fastq, "PEEK", peek)
    for trial in range(25):
        want, text = records(120, R.choice(["\n", "\r\n"]))
        lines = text.splitlines(keepends=True)
        gone = {4 * R.randrange(120) + R.randrange(4) for _ in range(R.randrange(6))}
        lines = ["" if i in gone else x for i, x in enumerate(lines)]
        lines.insert(4 * R.randrange(100), R.choice(["", "\n", "no record\n"]))
        (tmp_path / "a.fastq").write_bytes("".join(lines).encode())
        whole = rows_of(str(tmp_path), 1 << 20)
        assert sum(r[-1] for r in whole) >= 120 - 2 * len(gone) - 1
        for split in (41, 300, 2000):
            assert rows_of(str(tmp_path), split) == whole


def test_paths(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("a.fastq", "b.fq", "_c.fastq"):
        (tmp_path / "d" / n).write_text("@é\nAC\n+\nII\n")
    at = str(tmp_path / "d")
    assert [len(fastq.files_of(p)) for p in (at, at + "/*.fastq", at + "/a.*", f"file://{at}", f"file:{at}/*.f*", at + "/none")] == [2, 1, 1, 2, 2, 0]
    assert [r.tag for r in read_fastq(spark, f"{at}/a.fastq,{at}/b.fq").collect()] == ["@é", "@é"]
    assert read_fastq(spark, at + "/none").count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(1, "@a\r\nAC\r\n+\r\nII"), (2, None), (3, ""), (None, "@b\nA\n+\nI\n@c\nAC\n+\nI\n@d\n")], "chunk_id long, t string")
    got = {(r.chunk_id, r.record_no): (r.tag, r.quality, r.valid) for r in chunk_rows(df, "chunk_id", "t").collect()}
    assert got == {(1, 1): ("@a", "II", True), (None, 1): ("@b", "I", True), (None, 2): ("@c", "I", False)}


def test_text_round_trip(spark, tmp_path):
    want, text = records(80)
    (tmp_path / "a.fastq").write_text(text)
    write_fastq(read_fastq(spark, str(tmp_path / "a.fastq"), 200), str(tmp_path / "out"))
    back = read_fastq(spark, str(tmp_path / "out")).orderBy("read_id").collect()
    assert [(r.tag, r.sequence, r.plus, r.quality) for r in back] == want


def test_archive(spark, tmp_path):
    want, text = records(90, plus=True)
    (tmp_path / "a.fastq").write_text(text)
    reads = read_fastq(spark, str(tmp_path / "a.fastq"), 500)
    at = str(tmp_path / "arc")
    archive.write_archive(reads, at, Options(crc32=True, buffer_mb=1))
    back = archive.read_archive(spark, at).orderBy("read_id").collect()
    assert [(r.tag, r.sequence, r.plus, r.quality) for r in back] == want
    assert archive.corrupt_blocks(spark, at).count() == 0
    broken = str(tmp_path / "broken")
    spark.read.parquet(f"{at}/reads").withColumn("quality", F.when(F.col("tag").startswith("@R.7 "), F.reverse("quality")).otherwise(F.col("quality"))).withColumn(
        "quality", F.when(F.col("tag").startswith("@R.7 "), F.concat(F.lit("~"), "quality")).otherwise(F.col("quality"))
    ).write.parquet(f"{broken}/reads")
    for part in ("blocks", "dataset"):
        spark.read.parquet(f"{at}/{part}").write.parquet(f"{broken}/{part}")
    assert archive.corrupt_blocks(spark, broken).count() == 1
    spark.read.parquet(f"{at}/dataset").withColumn("major", F.lit(9)).write.parquet(str(tmp_path / "new/dataset"))
    with pytest.raises(ValueError, match="version"):
        archive.read_archive(spark, str(tmp_path / "new"))
    spark.read.parquet(f"{at}/blocks").limit(0).write.parquet(str(tmp_path / "short/blocks"))
    spark.read.parquet(f"{at}/dataset").write.parquet(str(tmp_path / "short/dataset"))
    with pytest.raises(ValueError, match="header"):
        archive.read_archive(spark, str(tmp_path / "short"))


def test_archive_blocks_close_over_budget(spark, tmp_path):
    rows = [(i, f"@t{i}", "A" * 500, "+", "I" * 500) for i in range(5000)]
    df = spark.createDataFrame(rows, "read_id long, tag string, sequence string, plus string, quality string")
    got = {r.read_id: r.block_id for r in archive.assign_blocks(df, 1).collect()}
    size = {}
    for i in range(5000):
        size[got[i]] = size.get(got[i], 0) + 1005 + len(f"@t{i}")
    assert len(got) == 5000 and sorted(size) == list(range(len(size))) and all((1 << 20) < v < (1 << 20) + 1100 for k, v in size.items() if k < len(size) - 1)
    assert [got[i] for i in range(5000)] == sorted(got.values())


def test_projected_titles(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@R.1 x:y\nAC\n+\nII\n")
    assert [r.tag for r in read_fastq(spark, str(tmp_path / "a.fq"), fields=(1, 3)).collect()] == ["@R.x:"]


def test_lossy_archive_is_idempotent(spark, tmp_path):
    _, text = records(60)
    (tmp_path / "a.fastq").write_text(text)
    reads = read_fastq(spark, str(tmp_path / "a.fastq"))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    archive.write_archive(reads, one, Options(lossy=True, fields=(1, 2), quality_offset=33))
    first = archive.read_archive(spark, one)
    archive.write_archive(first, two, Options(lossy=True, quality_offset=33))
    rows = lambda df: [(r.tag, r.sequence, r.quality) for r in df.orderBy("read_id").collect()]
    assert rows(first) == rows(archive.read_archive(spark, two))
    assert all(t.endswith(" ") for t, _, _ in rows(first))


def test_inconsistent_dataset_is_rejected(spark, tmp_path):
    df = spark.createDataFrame([(1, "@a", "AC", "+", "II"), (2, "@b", "AC", "+b", "II")], "read_id long, tag string, sequence string, plus string, quality string")
    with pytest.raises(ValueError):
        archive.write_archive(df, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        archive.write_archive(df.limit(1), str(tmp_path / "x"))


def test_command_line(spark, tmp_path):
    from readmill import __main__ as cli

    _, text = records(20)
    src, arc, out = (str(tmp_path / x) for x in ("a.fastq", "arc", "out"))
    (tmp_path / "a.fastq").write_text(text)
    assert cli.main(["c", src, src]) == 2 and cli.main(["c", src, arc, "-d", "9"]) == 2
    assert cli.main(["c", src, arc, "-m", "1", "-c"]) == 0 and cli.main(["d", arc, out]) == 0
    body = "".join((tmp_path / "out" / f).read_text() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert body == text


def test_streaming(spark, tmp_path, small):
    from readmill.streaming import ingest

    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.fastq").write_text(records(10)[1])
    ingest.run_available(ingest.fastq_stream(spark, str(tmp_path / "in"), split_bytes=300), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).filter("valid").count() == 30
    (tmp_path / "in" / "9.fastq").write_text(records(5)[1])
    ingest.run_available(ingest.fastq_stream(spark, str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 35
    raw = spark.read.parquet(f"{small}/fastq_reads.parquet")
    raw.write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "reads"))
    ingest.run_available(ingest.once_within(stream, "read_id", "ingested_at", "60 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == raw.select("read_id").distinct().count()
    ingest.run_available(ingest.arrivals(stream, "produced_at", "1 day", "1 day", "run_id"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "o3")).agg(F.sum("n")).first()[0] > 0


def test_examples(spark, tmp_path):
    import importlib.util
    import pathlib

    def example(name):
        spec = importlib.util.spec_from_file_location(name, pathlib.Path(__file__).parents[1] / "examples" / f"{name}.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module

    want, text = records(50)
    (tmp_path / "a.fq").write_text(text)
    assert example("records").main(spark, str(tmp_path / "a.fq"), str(tmp_path / "r")) == 50
    example("paths").main(spark, str(tmp_path / "a.fq"), str(tmp_path / "p"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == text
    report = {r.stream: (r.encoded_bytes, r.stored_bytes) for r in archive.stream_report(spark, str(tmp_path / "p")).collect()}
    assert set(report) == {"meta", "tag", "dna", "quality"} and all(x > 0 for v in report.values() for x in v)


def test_record_writer(spark, tmp_path):
    from readmill import api

    want = [api.Record(*r) for r in records(30)[0]]
    with api.RecordWriter(spark, str(tmp_path / "a"), Options(buffer_mb=1)) as w:
        for r in want:
            w.write(r)
            w.held += 1 << 18  # as if records were long: several parts are stored
    assert list(api.records(spark, str(tmp_path / "a"), archive=True)) == want
    with pytest.raises(ValueError):
        api.RecordWriter(spark, str(tmp_path / "b")).finish()
    with pytest.raises(KeyError):
        with api.RecordWriter(spark, str(tmp_path / "c")) as w:
            raise KeyError
    assert not (tmp_path / "c").exists()


def test_pipes(spark, tmp_path, monkeypatch, capsys):
    import io
    import types

    from readmill import __main__ as cli

    text = records(25)[1]
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(text.encode())))
    assert cli.main(["c", "-s", str(tmp_path / "arc"), "-v"]) == 0
    assert "records\t25" in capsys.readouterr().err
    assert cli.main(["d", "-s", str(tmp_path / "arc")]) == 0 and capsys.readouterr().out == text
    assert cli.main(["c", "-s", "a", "b"]) == 2 and cli.main(["c", "a"]) == 2


def test_records_and_stdout(spark, tmp_path, capsys):
    from readmill import __main__ as cli
    from readmill import api

    want, text = records(15)
    (tmp_path / "a.fq").write_text(text)
    api.compress(spark, str(tmp_path / "a.fq"), str(tmp_path / "arc"), Options(crc32=True))
    assert [tuple(r) for r in api.records(spark, str(tmp_path / "arc"), archive=True)] == want
    assert [tuple(r) for r in api.records(spark, str(tmp_path / "a.fq"))] == want
    capsys.readouterr()
    assert cli.main(["d", str(tmp_path / "arc"), "-"]) == 0
    assert capsys.readouterr().out == text
    (tmp_path / "bad.fq").write_text("@a\nAC\n+\nI\n@b\nAC\n+\nII\n")
    assert cli.main(["c", str(tmp_path / "bad.fq"), str(tmp_path / "no")]) == 1
    assert [r.tag for r in api.records(spark, str(tmp_path / "bad.fq"), skip_damaged=True)] == ["@b"]
    with pytest.raises(ValueError):
        list(api.records(spark, str(tmp_path / "bad.fq")))
