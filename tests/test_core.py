import binascii
import math
import random

import pytest
from pyspark.sql import functions as F

from readmill.functions import bases as B
from readmill.functions import tags as T
from readmill.operators import blocks, ordered, packed_fields, rejects, titles, units
from readmill.plans.options import Options
from readmill.plans.runtime import once_per_id

R = random.Random(3)


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


# --- problem 2: units --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "note, want",
    [
        ("plain decimal scores", ("score", 1.0, None)), ("Phred x 10, rounded", ("score", 0.1, None)),
        ("scores written in tenths of a Phred unit", ("score", 0.1, None)), ("values are error probabilities per base", ("probability", 1.0, None)),
        ("chance of a wrong call, 3 digits", ("probability", 1.0, None)), ("character code minus fifty-nine", ("code", 1.0, 59)),
        ("characters start at base 33 (bang)", ("code", 1.0, 33)), ("zero score is the at-sign, one character per base", ("code", 1.0, 64)),
        ("error probability in percent", ("probability", 0.01, None)), ("deciphred", ("score", 0.1, None)), ("", None), (None, None), ("no remarks", None),
    ],
)
def test_notes(note, want):
    r = units.read_note(note)
    assert (r and (r.dimension, round(r.scale, 9), r.offset)) == want


@pytest.mark.parametrize(
    "note, want",
    [
        ("phred33", ("code", 1.0, 33)), ("Phred+64", ("code", 1.0, 64)), ("ASCII, offset 59", ("code", 1.0, 59)), ("quality = ord(c) - 64 (ascii)", ("code", 1.0, 64)),
        ("error rate in parts per thousand", ("probability", 1e-3, None)), ("error probability x 10^3", ("probability", 1e-3, None)),
        ("probabilities in units of 10^-6", ("probability", 1e-6, None)), ("error probability [ppm]", ("probability", 1e-6, None)),
        ("chances of a wrong call, per mille", ("probability", 1e-3, None)), ("P(error) in %", ("probability", 0.01, None)), ("odds of a wrong call", ("odds", 1.0, None)),
        ("-10 log10 P", ("score", 1.0, None)), ("log10 of the error probability", ("score", -10.0, None)), ("-log10(p)", ("score", 10.0, None)),
        ("negative log10 of the error rate", ("score", 10.0, None)), ("natural log of the error probability", ("score", -10 / math.log(10), None)),
        ("-100 × log10 p", ("score", 0.1, None)), ("decibels", ("score", 1.0, None)), ("centibels", ("bel", 0.01, None)), ("millibel", ("bel", 0.001, None)),
        ("Phred scores multiplied by 100", ("score", 0.01, None)), ("scores × 10³", ("score", 1e-3, None)), ("quality values divided by 10", ("score", 10.0, None)),
        ("hundredths of a score", ("score", 0.01, None)), ("scores in steps of 0.5", ("score", 0.5, None)), ("deci-Phred", ("score", 0.1, None)), ("dB", ("score", 1.0, None)),
        ("Q-scores times ten", ("score", 0.1, None)), ("likelihood of error in per cent", ("probability", 0.01, None)), ("sequenced on lane 4, 2 runs", None), ("kept at -20 degrees", None),
    ],
)
def test_notes_of_other_kinds(note, want):
    r = units.read_note(note)
    assert (r and (r.dimension, pytest.approx(r.scale), r.offset)) == want


def test_units_are_confirmed_by_the_values():
    lists = lambda least, most, whole=False: {"rows": 9, "lists": 9, "low": None, "high": None, "least": least, "most": most, "whole": whole}
    assert units.run_unit(lists(2, 41, True), "error probabilities", None) == ("scaled", 1.0)
    assert units.run_unit(lists(0.08, 630), "error rate in parts per thousand", None) == ("probability", 0.001)
    assert units.run_unit(lists(-4.1, -0.2), "log10 of the error probability", None) == ("scaled", -10.0) == units.run_unit(lists(-4.1, -0.2), "", None)
    assert units.run_unit(lists(0.0001, 1.7), "odds of a wrong call", None) == ("odds", 1.0)
    assert units.run_unit(lists(20, 410, True), None, 33) == ("scaled", 0.1)
    codes = lambda low, high: {"rows": 9, "lists": 0, "low": low, "high": high, "least": None, "most": None, "whole": None}
    assert units.run_unit(codes(66, 104), None, 33) == ("code", 64.0) and units.run_unit(codes(64, 74), "phred64", 33) == ("code", 64.0)


def test_phred_sums(spark):
    def lines(run, quals, first):
        return [(first + i, run, q) for i, q in enumerate(quals)]

    code = lambda o: ["".join(chr(o + q) for q in qs) for qs in ([0, 41, 20], [2, 2, 40])]
    rows = (
        lines(1, code(33), 0) + lines(2, code(64), 10) + lines(3, code(59), 20) + lines(4, ["30 31 2", "41 3"], 30) + lines(5, ["300 310 25", "410 30"], 40)
        + lines(6, ["0.001 1e-4", "0.631 7.94e-05"], 50) + lines(7, ["30,31, 2", "41;3"], 60) + lines(8, ["3.0 4.1", "0.2 3.3"], 70)
        + [(80, 1, ""), (81, 1, None), (None, 4, "7 8"), (10, 2, code(64)[0]), (90, None, "!J"), (91, 99, "J!")]
    )
    df = spark.createDataFrame(rows, "read_id long, run_id long, quality string").selectExpr("*", "'x' as unit", "1 as parameter")
    meta = spark.createDataFrame(
        [(1, 64, None), (2, 33, "no remarks"), (3, None, None), (4, 33, ""), (5, 0, None), (6, None, "chance of a wrong call"), (7, 0, None), (8, 0, "in bels")],
        "run_id long, quality_offset int, quality_note string",
    )
    got = {r.id: (r.unit, r.parameter, r.phred_sum) for r in units.phred_sums(df, "read_id", "quality", "run_id", meta).collect()}
    p = lambda *v: sum(math.floor(-10 * math.log10(x) + 0.5) for x in v)
    assert got == {
        0: ("code", 33.0, 61), 1: ("code", 33.0, 44), 10: ("code", 64.0, 61), 11: ("code", 64.0, 44), 20: ("code", 59.0, 61), 21: ("code", 59.0, 44),
        30: ("scaled", 1.0, 63), 31: ("scaled", 1.0, 44), 40: ("scaled", 0.1, 64), 41: ("scaled", 0.1, 44), 50: ("probability", 1.0, p(0.001, 1e-4)),
        51: ("probability", 1.0, p(0.631, 7.94e-05)), 60: ("scaled", 1.0, 63), 61: ("scaled", 1.0, 44), 70: ("scaled", 10.0, 71), 71: ("scaled", 10.0, 35),
        80: ("code", 33.0, 0), None: ("scaled", 1.0, 15), 90: ("code", 33.0, 41), 91: ("code", 33.0, 41),
    }
    assert units.phred_sums(df.limit(0), "read_id", "quality", "run_id", meta).count() == 0


# --- problem 3: rejects ------------------------------------------------------------------------


def reference_reason(line):
    line = (line or "").removesuffix("\r")
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    break
                text, i = text + line[i], i + 1
            i += 1
            if line[i : i + 1] not in ("", ","):
                return "quoting"
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            text, i = line[i:j], j
            if '"' in text:
                return "quoting"
        fields.append(text)
        if i >= len(line):
            break
        i += 1
    return "columns" if len(fields) != 4 else rejects.checked(tuple(fields))


def test_rejects(spark):
    fixed = [
        "@a,ACGT,+,IIII", '"@a, b",ACGT,+,"I""I,"', '"@a\nb",AC,+,II', "@a,ACGT,+", "@a,ACGT,+,IIII,", "", None, "a,ACGT,+,IIII", "@a,acgt,+,IIII",
        "@a,,+,", "@a,ACGT,-,IIII", "@a,ACGT,+,II", "@a,AC,+,I ", '@a"b,AC,+,II', '"@a"b,AC,+,II', '"@a,AC,+,II', '@a"b,"AC,+,II', '"@a" ,AC,+,II',
        '@a,AC,+,"II', ',,,"', '"""@a""",AC,+,II', "@a,AC,+,II\r", "@a,AC,+,II\r\r", "@é,AC,+,II", "@a,AC,+,éé", "@a," + "A" * 100_000 + ",+," + "I" * 100_000,
        "@x,NULL,+,NULL", '"@a","AC","+","II"', "@a,AC\r,+,II", "@a,AC,+,II\n", '@a,AC,"+",II"', '""', '","', "@\x00a,AC,+,II",
    ]
    pieces = ['"', '""', ",", "@a", "AC", "+", "II", " ", "x", "\r"]
    lines = fixed + ["".join(R.choice(pieces) for _ in range(R.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id int, raw_line string").selectExpr("*", "1 as reason", "2 as title").repartition(3)
    got = {r.id: r for r in rejects.load_records(df, "raw_id", "raw_line").collect()}
    assert len(got) == len(lines)
    for i, x in enumerate(lines):
        assert got[i].reason == reference_reason(x), (x, got[i])
        assert got[i].raw_line == x
    # most of the reasons come from the reader's reject table
    said = [(r.reason, r.reader_error) for r in got.values()]
    assert {e for w, e in said if w == "columns"} == {"MISSING COLUMNS", "TOO MANY COLUMNS"}
    broken = [e for w, e in said if w == "quoting"]
    assert 3 * broken.count("UNQUOTED VALUE") > len(broken) and all(w == "quoting" for w, e in said if e == "UNQUOTED VALUE")
    assert got[1].title == "@a, b" and got[1].quality == 'I"I,' and got[2].title == "@a\nb"
    twice = rejects.load_records(df.unionByName(df.filter("raw_id = 0")).withColumn("raw_id", F.expr("nullif(raw_id, 1)")), "raw_id", "raw_line")
    assert twice.count() == len(lines) + 1
    assert rejects.load_records(df.limit(0), "raw_id", "raw_line").count() == 0


# --- problem 4: packed fields ------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("a;b", {1: "a", 2: "b"}), ("a ,, b", {1: "a", 3: "b"}), ("'x;y'|z", {1: "x;y", 2: "z"}), ('"a""b";c', {1: 'a"b', 2: "c"}),
        ('O"K; 5\'-x', {1: 'O"K', 2: "5'-x"}), ('"a,b', {1: '"a', 2: "b"}), ('"a", "b"', {1: "a", 2: "b"}), ('""', {}), (" ; ", {}),
        ("'a\t b':\"c|d\" :e", {1: "a\t b", 2: "c|d", 3: "e"}), ('"a"x,b', {1: '"a"x', 2: "b"}), ('x "a,b"', {1: 'x "a', 2: 'b"'}),
        ("'it''s; ok',z", {1: "it's; ok", 2: "z"}), ('","', {1: ","}), ('"a,"b', {1: '"a', 2: '"b'}),
    ],
)
def test_packed(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, field_text string")
    got = packed_fields.split_values(df, "id", F.col("field_text")).collect()
    assert {r.pos: r.field_text for r in got} == want


def test_packed_rows(spark):
    rows = [(1, "@t a;b"), (1, "@t a;b"), (2, None), (3, "@only"), (None, "@t x"), (None, "@t x"), (4, "@t " + "v;" * 50_000), (5, "")]
    df = spark.createDataFrame(rows, "id long, pos string")
    got = packed_fields.split_values(df, "id", packed_fields.description(F.col("pos"))).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 2, None: 2, 4: 50_000}
    assert packed_fields.split_values(df.limit(0), "id", F.col("pos")).count() == 0
    known = packed_fields.split_values(spark.createDataFrame([(1, "x;y;z")], "id long, t string"), "id", F.col("t"), ["y;z"]).collect()
    assert [(r.pos, r.field_text) for r in known] == [(1, "x"), (2, "y;z")]


def test_dictionary_of_the_corpus(spark):
    rows = [(1, "'x;y'|z"), (2, 'a;"p,q""r",b'), (3, "'x;y'"), (4, None), (5, "plain; text"), (6, "5'-x;y'"), (7, '"no delimiter"')]
    df = spark.createDataFrame(rows, "id long, value string").selectExpr("*", "1 as n")
    got = {r.value: r.n for r in packed_fields.value_dictionary(df, F.col("value")).collect()}
    assert got == {"'x;y'": 2, '"p,q""r"': 1}
    assert packed_fields.bounded_values(packed_fields.value_dictionary(df, F.col("value")), 13) == ('"p,q""r"', "'x;y'")
    assert packed_fields.bounded_values(packed_fields.value_dictionary(df, F.col("value")), 12) is None
    fields = lambda **kw: sorted(tuple(r) for r in packed_fields.split_values(df, "id", F.col("value"), **kw).collect())
    assert fields() == fields(dictionary_bytes=0) and (2, 2, 'p,q"r') in fields() and (1, 1, "x;y") in fields()
    # without the automaton's places the quoted values fall apart
    without = [r for b in packed_fields._segment((), True)(iter([df.select("id", "value").filter("value is not null").toArrow().to_batches()[0]])) for r in b.to_pylist()]
    assert {"id": 1, "pos": 1, "field_text": "'x"} in without


# --- scalar functions --------------------------------------------------------------------------


def test_lossy_fixture(spark):
    q = "!\"#*+459:>?CDHIJ"
    want = "''''0077<<BBFFII"
    df = spark.createDataFrame([(i, c) for i, c in enumerate(q)], "i int, c string")
    base, s = B.lossy_pair(F.lit(0), B.score(F.col("c"), 33))
    got = df.select("i", base.alias("b"), B.symbol(s, 33).alias("s")).orderBy("i").collect()
    assert "".join(r.s for r in got) == want and {r.b for r in got} == {"A"}
    base, s = B.lossy_pair(F.lit(5), F.lit(40))
    assert one(spark, base, s) == ["N", 0]


def test_transfer_fixture(spark):
    df = spark.createDataFrame([(1, 1, 1, "ANRA", "I#-I")], "read_id long, block_id long, run_id long, sequence string, quality string")
    rows = blocks.with_transfer(blocks.positions(df)).orderBy("pos").collect()
    assert [r.code for r in rows] == [40, 130, 12, 40] and [r.idx for r in rows if r.kept] == [0, 5, 0]
    back = spark.createDataFrame([(c,) for c in range(128, 128 + 15 * 8)], "code int").select(
        B.restored_index(F.col("code")).alias("i"), B.restored_score(F.col("code")).alias("q"), "code"
    )
    assert all(r.code == r.q + 128 + (r.i - 4) * 8 and 4 <= r.i <= 18 for r in back.collect())


def test_index_and_numbers(spark):
    letters = spark.createDataFrame([(c,) for c in B.BASE_ORDER + "a?"], "b string")
    assert [r[0] for r in letters.select(B.base_index(F.col("b"))).collect()] == [*range(19), None, None]
    texts = spark.createDataFrame([("0",), ("12",), ("012",), ("",), ("1a",), ("12345678901234567890",)], "t string")
    assert [r[0] for r in texts.select(T.number(F.col("t"))).collect()] == [0, 12, None, None, None, None]
    assert one(spark, *[B.bit_length(F.lit(x)) for x in (0, 1, 2, 255, 256)]) == [0, 1, 2, 8, 9]


def test_tag_fixture(spark):
    tag = F.lit("@SRR001.1 071112:7:1/1 length=36")
    assert one(spark, T.project(tag, [1, 2]))[0] == "@SRR001.1 "
    df = spark.range(1).select(F.posexplode(T.tokens(tag)).alias("k", "x")).select("k", T.field_text(F.col("x")).alias("t"), T.number(T.field_text(F.col("x"))).alias("n"))
    rows = df.orderBy("k").collect()
    assert [r.t for r in rows] == ["@SRR001", "1", "071112", "7", "1", "1", "length", "36"] and rows[2].n is None
    assert one(spark, T.project(F.lit("@a b"), [7]))[0] == ""


def test_offsets_and_plus(spark):
    for (lo, hi), want in {(33, 73): 33, (64, 104): 64, (59, 104): 59, (66, 74): 33, (35, 80): 33, (40, 120): 33, (20, 73): None}.items():
        assert one(spark, B.offset_from_range(F.lit(lo), F.lit(hi)))[0] == want
    assert one(spark, B.plus_line(F.lit("@a b"), True), B.plus_line(F.lit("@a b"), False)) == ["+a b", "+"]
    assert one(spark, F.crc32(F.lit("abc").cast("binary")))[0] == 891568578 == binascii.crc32(b"abc")
    assert one(spark, B.valid_record(F.lit("@a"), F.lit("AC"), F.lit("+"), F.lit("I")), B.valid_record(F.lit(None), F.lit("A"), F.lit("+"), F.lit("I"))) == [False, False]


# --- ordered operators -------------------------------------------------------------------------


def test_runs_and_tail(spark):
    df = spark.createDataFrame([(1, i, 7) for i in range(600)] + [(1, 600, None), (1, 601, 7)], "b long, i long, v int")
    pieces = ordered.runs(df, ["b"], ["i"], "v", 255).orderBy("run_no", "piece_no").collect()
    assert [(r.v, r.piece_length) for r in pieces] == [(7, 255), (7, 255), (7, 90), (None, 1), (7, 1)]
    again = ordered.expand(ordered.runs(df, ["b"], ["i"], "v", 255), ["b"], "v").orderBy("ordinal").collect()
    assert [r.v for r in again] == [7] * 600 + [None, 7]
    reads = spark.createDataFrame([(1, 1, 1, "AAA", "I##"), (2, 1, 1, "AAA", "###"), (3, 1, 1, "", "")], "read_id long, block_id long, run_id long, sequence string, quality string")
    got = blocks.quality_lengths(blocks.with_offset(reads)).first()
    assert (got.raw_len, got.th_len, got.rle_len) == (6, 0, 1) and got.scheme == "truncated"


def test_colour_space(spark):
    df = spark.createDataFrame([("T0123.",)], "s string")
    r = ordered.bases_to_colours(ordered.colours_to_bases(df, "s"), "bases").first()
    assert r.bases == "TTGATN" and r.colours == "T0123."
    many = spark.createDataFrame([("ACGT"[R.randrange(4)] + "".join(R.choice("0123.") for _ in range(30)),) for _ in range(200)], "s string")
    assert ordered.bases_to_colours(ordered.colours_to_bases(many, "s"), "bases").filter("colours <> s").count() == 0


def test_once_per_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "x"), (None, "x")], "read_id long, v string")
    assert sorted(map(str, once_per_id(df).collect())) == sorted(map(str, [r for r in df.distinct().collect() if r.read_id] + df.filter("read_id is null").collect()))


def test_title_schemes(spark):
    rows = [(i, 1, f"@R.{i * 3}_7_{R.randrange(10**6)}") for i in range(200)]
    df = spark.createDataFrame(rows, "read_id long, block_id long, tag string")
    s = {r.field_no: r for r in titles.number_scheme(titles.title_fields(df)).collect()}
    assert s[2].scheme == "delta_const" and s[3].scheme == "delta_const" and s[4].scheme == "value_var"
    assert not titles.mixed_blocks(df).first().mixed
    assert titles.mixed_blocks(df.union(spark.createDataFrame([(900, 1, "@odd")], df.schema))).first().mixed


def test_titles_by_template(spark):
    """Fields, mixed blocks and schemes worked out by hand."""
    rows = [
        (1, 1, "@R.1 7:a"), (2, 1, "@R.2 8:b:c"), (3, 1, "@R.x.3 9:"),  # the first field is up to the first dot, the last one is the rest
        (4, 2, "@R.1 7:a"), (5, 2, "@R.1 7"), (6, 2, "@R.1 7:b"),  # one title lacks the colon
        (8, 3, "@q"), (7, 3, "@p"), (9, 3, None), (10, 4, "@z 1"), (11, 4, "@z 1/2"), (12, 4, ""),
    ]
    df = spark.createDataFrame(rows, "read_id long, block_id long, tag string")
    assert {r.block_id: (r.mixed, r.title_coder) for r in titles.mixed_blocks(df).collect()} == {
        1: (False, "tokenised"), 2: (True, "raw"), 3: (False, "tokenised"), 4: (True, "raw"),
    }
    got = {}
    for r in titles.title_fields(df).orderBy("read_id", "field_no").collect():
        got.setdefault(r.read_id, []).append((r.field_text, r.sep, r.num))
    assert got == {
        1: [("@R", ".", None), ("1", " ", 1), ("7", ":", 7), ("a", "", None)], 2: [("@R", ".", None), ("2", " ", 2), ("8", ":", 8), ("b:c", "", None)],
        3: [("@R", ".", None), ("x.3", " ", None), ("9", ":", 9), ("", "", None)], 7: [("@p", "", None)], 8: [("@q", "", None)],
    }
    assert titles.title_fields(df.limit(0)).count() == 0 and titles.mixed_blocks(df.limit(0)).count() == 0


def number_fields(spark, *columns):
    rows = [(i, 1, k + 1, str(v), "", v) for k, c in enumerate(columns) for i, v in enumerate(c)]
    return spark.createDataFrame(rows, "read_id long, block_id long, field_no int, field_text string, sep string, num long")


def test_number_schemes_by_hand(spark):
    n = 600
    wide = [R.randrange(10**6) for _ in range(n)]
    rising = [0]
    for i in range(1, n):
        rising.append(rising[-1] + 1000 + R.randrange(100))
    far = [0]
    for i in range(1, n):
        far.append(far[-1] + 10**6 * (i % 7) ** 5 + i * i)
    cols = ([5] * n, [i // 300 for i in range(n)], list(range(n)), wide, rising, [R.randrange(300) for _ in range(n)], [1, 2, 4, 8], far)
    got = {r.field_no: r for r in titles.number_scheme(number_fields(spark, *cols)).collect()}
    kinds = [(got[k].coding, got[k].scheme, got[k].huffman, got[k].coded_bits) for k in range(1, 9)]
    assert kinds[0] == ("delta", "delta_const", False, 0) and (got[1].value_runs, got[1].delta_runs) == (3, 3)  # 599 repeats: 256, 256 and 87
    assert kinds[1] == ("delta", "delta_rle", False, 1) and got[2].value_runs == 2 + 2  # each run of 299 repeats is stored twice
    assert kinds[2] == ("delta", "delta_const", False, 0) and got[3].value_runs == n - 1
    assert kinds[3] == ("value", "value_var", False, 20) and kinds[5] == ("value", "value_var", True, 9)
    # the range of the deltas decides about the code of a field that is coded by deltas
    assert kinds[4] == ("delta", "delta_var", True, 7) and got[5].value_range > 512
    assert kinds[6] == ("delta", "delta_rle", False, 2) and (got[7].value_runs, got[7].delta_runs) == (3, 2)  # 4 records, 2 stored deltas: 4 / 2 is more than 1.25
    assert kinds[7][1:3] == ("delta_var", False)
    values = {r.num: r.n for r in titles.value_histogram(number_fields(spark, cols[1], wide)).collect()}
    assert values == {0: 300, 1: 300}
    steps = {(r.field_no, r.delta): r.n for r in titles.delta_histogram(number_fields(spark, cols[1], wide, list(range(n)))).collect()}
    assert steps == {(1, 0): 598, (1, 1): 1, (3, 1): 599}


def test_options():
    assert Options.preset(2, lossy=True).quality_order == 6 and Options.preset(1).dna_order == 6 and Options.preset(0).buffer_mb == 8
    assert Options.preset(0).quality_coder == "lossless_static" and Options.preset(2, lossy=True).quality_coder == "lossy_order" and Options.preset(1).base_coder == "order"
    for bad in ({"dna_level": 4}, {"quality_level": 3}, {"buffer_mb": 0}, {"quality_offset": 20}, {"threads": 65}, {"fields": (0,)}):
        with pytest.raises(ValueError):
            Options(**bad)


# --- codecs ------------------------------------------------------------------------------------


def test_codecs_round_trip():
    import numpy as np

    from readmill.operators import codecs as C

    rng = np.random.default_rng(4)
    for n, k in ((0, 1), (1, 1), (50, 1), (1000, 2), (5000, 40), (3000, 250)):
        x = rng.integers(0, k, n)
        y, at = C.huffman_decode(C.huffman_encode(x))
        assert (x == y).all() and at == len(C.huffman_encode(x))
    counts = np.array([2**i for i in range(40)])
    assert C.code_lengths(counts).max() <= C.LONGEST
    counts = rng.integers(1, 100, 20)
    heap, cost = sorted(counts.tolist()), 0  # the size of a Huffman code is the sum of the merges
    while len(heap) > 1:
        cost += heap[0] + heap[1]
        heap = sorted([heap[0] + heap[1], *heap[2:]])
    lengths = C.code_lengths(counts)
    assert (lengths * counts).sum() == cost and abs(sum(2.0**-lengths) - 1) < 1e-12
    for make in (lambda: "I" * 30, lambda: "".join(R.choice("#+5:?I") for _ in range(30)), lambda: "I?" * 6 + "#" * 18):
        quals = [make() for _ in range(40)] + [""]
        seqs = ["".join(R.choice("ACGTN-R") for _ in q) for q in quals]
        tags = [f"@R.{i} é" for i in range(len(quals))]
        coded = C.encode_block(tags, seqs, quals, 33)
        assert C.decode_block(*coded, 33) == (tags, seqs, quals)
    assert C.decode_block(*C.encode_block([], [], [], 33), 33) == ([], [], [])


def test_titles_round_trip():
    import numpy as np

    from readmill.operators import codecs as C

    blocks_ = [
        [f"@R.{i} {i // 9}:{R.randrange(10**9)}_{'ab'[i % 2]} x" for i in range(60)], ["@same 1"] * 5, ["@one"], [], ["@a.1", "@b"], ["@a 01", "@a 1", "@a 2"],
        [f"@k {v}" for v in (5, 5, 5, 9, 9, 1)], [f"@é:{'x' * (i % 4)}.{i}" for i in range(9)], ["", "a", " "], [f"@d {7 * i}" for i in range(400)], [f"@w {10**17 * (i % 2)}" for i in range(20)],
    ]
    for t in blocks_:
        coded = C.titles_encode(t)
        assert C.titles_decode(coded, len(t)) == t
        assert coded[:1] == (b"R" if t in (blocks_[3], blocks_[4]) else b"T")
    assert len(C.titles_encode(blocks_[9])) < 60
    for v in ([0] * 700, list(range(9)), [1, 2, 4, 8], [R.randrange(10) for _ in range(300)], [3, 3]):
        assert C.number_scheme(np.array(v)) in C.SCHEMES


def test_number_scheme_of_the_codec_is_that_of_the_statistics(spark):
    import numpy as np

    from readmill.operators import codecs as C

    cols = [[R.randrange(k) for _ in range(80)] for k in (2, 5, 1000)] + [[i // m for i in range(80)] for m in (1, 2, 3, 20)] + [[i * i for i in range(80)], [5] * 80, [i % 7 for i in range(80)]]
    got = {r.field_no: r.scheme for r in titles.number_scheme(number_fields(spark, *cols)).collect()}
    assert [got[k + 1] for k in range(len(cols))] == [C.number_scheme(np.array(c)) for c in cols]


@pytest.mark.parametrize("size, order, sides", [(4, 0, 1), (4, 3, 1), (4, 9, 1), (8, 2, 1), (16, 1, 8), (64, 2, 8), (19, 3, 1)])
def test_range_coder_round_trip(size, order, sides):
    import numpy as np

    from readmill.operators import range_codec as C

    rng = np.random.default_rng(size + order)
    length = [0, 1, 2, 700, 300, 4000, 4000, 50]
    lanes = [np.minimum(rng.geometric(0.4, n) - 1, size - 1) for n in length]
    lanes[3][:], lanes[4][:] = 0, rng.integers(0, size, 300)  # one symbol only, all alike
    side, fresh = [rng.integers(0, sides, n) for n in length], [rng.random(n) < 0.02 for n in length]
    m = C.Model(size, order, sides)
    coded = C.encode(m, lanes, side, fresh)
    for a, b in zip(lanes, C.decode(m, coded, np.array(length), side, fresh)):
        assert (a == b).all()
    assert coded[0] == b"" and len(coded[3]) < (120 if sides > 1 else 60)
    if order == 0:  # close to the entropy of the symbols
        p = np.bincount(lanes[5]) / 4000
        bits = -(p * np.log2(p, where=p > 0, out=np.zeros_like(p))).sum() * 4000
        assert 8 * len(coded[5]) < bits * 1.02 + 200
    assert C.encode(m, [], [], []) == [] == C.decode(m, [], np.zeros(0, np.int64), [], [])


def coded_one_by_one(size, order, symbols, side, fresh):
    """The format of the order-k coder, a symbol at a time."""
    counts, history, out = {}, 0, bytearray()
    low, width = 0, (1 << 32) - 1
    for x, place, begins in zip(symbols, side, fresh):
        history = 0 if begins else history
        n = counts.setdefault((place, history), [1] * size)
        total = sum(n)
        low, width = low + width // total * sum(n[:x]), width // total * n[x]
        n[x] += 2
        if total + 2 > (1 << 16) - 2 * size:
            n[:] = [(k + 1) // 2 for k in n]
        history = (history * size + x) % size**order
        while (low ^ (low + width)) < 1 << 24 or width < 1 << 16:
            if (low ^ (low + width)) >= 1 << 24:
                width = -low & 0xFFFF
            out.append(low >> 24)
            low, width = low << 8 & 0xFFFFFFFF, width << 8
    return bytes(out) + low.to_bytes(4, "big") if len(symbols) else b""


@pytest.mark.parametrize("size, order, sides", [(4, 0, 1), (4, 9, 1), (8, 3, 8), (19, 1, 1), (64, 2, 8)])
def test_order_coder_keeps_its_format(size, order, sides):
    import numpy as np

    from readmill.operators import range_codec as C

    rng = np.random.default_rng(size * 10 + order)
    length = [900, 0, 1, 40, {4: 52000, 19: 36000}.get(size, 0) if order < 2 else 3000]
    lanes = [np.minimum(rng.geometric(0.3, n) - 1, size - 1) for n in length]
    lanes[4][: length[4] // 2] = rng.random(length[4] // 2) < 0.002  # halves counts, and widths become small
    side, fresh = [rng.integers(0, sides, n) for n in length], [rng.random(n) < 0.01 for n in length]
    if order < 2:
        fresh[4][:] = order == 1
    m = C.Model(size, order, sides)
    coded = C.encode(m, lanes, side, fresh)
    assert coded == [coded_one_by_one(size, order, x.tolist(), p.tolist(), f.tolist()) for x, p, f in zip(lanes, side, fresh)]
    assert all((a == b).all() for a, b in zip(lanes, C.decode(m, coded, np.array(length), side, fresh)))


def test_order_coder_takes_many_small_blocks_at_once():
    import time

    import numpy as np

    from readmill.operators import range_codec as C

    rng = np.random.default_rng(9)
    for m in (C.Model(4, 9), C.Model(64, 2, 8)):  # the tables of all contexts have 4 and 8 MB a block

        def seconds(n):
            lanes, side = [rng.integers(0, min(m.size, 40), 200) for _ in range(n)], [np.arange(200) * m.sides // 200] * n
            began = time.process_time()
            back = C.decode(m, C.encode(m, lanes, side), np.full(n, 200), side)
            took = time.process_time() - began
            assert all((a == b).all() for a, b in zip(lanes, back))
            return took

        seconds(8)
        assert seconds(800) < 25 * min(seconds(8) for _ in range(3))


def test_order_coded_blocks(spark):
    rows = [(i // 20, i, "".join(R.choice("ACGT" if i < 40 else "ACGTNRY-K") for _ in range(30)), "".join(chr(33 + R.randrange(41)) for _ in range(30)), 33) for i in range(100)]
    df = spark.createDataFrame(rows, "block_id long, read_id long, sequence string, quality string, offset int").repartition(3)
    from readmill.operators import range_codec as C

    for k, q, lossy in ((3, 1, False), (9, 2, False), (6, 3, True)):
        got = C.order_coded_sizes(df, k, q, lossy).collect()
        assert sorted(r.block_id for r in got) == [0, 1, 2, 3, 4] and all(r.round_trip and r.n_records == 20 and r.n_symbols == 600 for r in got)
    assert C.order_coded_sizes(df.limit(0), 3, 1).count() == 0


def test_all_core_queries_run(spark, small):
    from readmill.queries import oracle_sql, queries

    names = queries()
    assert set(oracle_sql()) <= set(names)
    for name in ("block_codec", "block_codec_k3", "block_codec_k9", "block_codec_lossy_k3", "block_crc", "quality_position_hist", "block_meta_check", "chunk_records", "p2_found", "p3_found", "p4_found"):
        assert names[name](spark, small).count() > 0
    for name in ("block_codec", "block_codec_k3", "block_codec_k9", "block_codec_lossy_k3"):
        assert names[name](spark, small).filter("not round_trip").count() == 0


def test_oracles_agree(spark, small):
    import glob
    import os

    import duckdb

    from readmill.queries import oracle_sql, queries

    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name in ("quality_scheme", "tag_scheme", "quality_runs", "lossy_reads", "p2_found", "p4_found"):
        a, b = queries()[name](spark, small).toPandas(), con.execute(oracle_sql()[name]).fetchdf()
        rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None)))
        assert rows(a) == rows(b), name


CONTEXT_READS = [(1, "ACGTACGTACGT", [0, 1, 2, 9, 10, 19, 20, 25, 30, 35, 40, 41]), (2, "NACA", [0, 40, 40, 2]), (3, "A", [7]), (4, "ANN-A", [2, 2, 9, 2, 2])]


def context_frame(spark):
    rows = [(i, 1, 1, s, "".join(chr(33 + x) for x in q)) for i, s, q in CONTEXT_READS]
    return blocks.with_offset(spark.createDataFrame(rows, "read_id long, block_id long, run_id long, sequence string, quality string"))


@pytest.mark.parametrize("order, lossy", [(1, False), (2, False), (4, False), (3, True), (9, True)])
def test_quality_contexts_of_any_order(spark, order, lossy):
    df = context_frame(spark)
    got = {(r.part, r.context, r.code): r.n for r in blocks.quality_contexts(df, order, lossy=lossy).collect()}
    codes = {(r.read_id, r.pos): r.code for r in blocks.with_transfer(blocks.positions(df.drop("offset"))).collect()}
    low, want = [0, 2, 10, 20, 25, 30, 35, 40], {}
    for i, s, q in CONTEXT_READS:
        bins = [0 if s[p] in "N-" else max(1, max(k for k in range(8) if low[k] <= q[p])) for p in range(len(s))]
        of = bins if lossy else [codes[i, p + 1] for p in range(len(s))]
        for p in range(len(s)):
            key = (p * 8 // len(s), ",".join(str(of[p - k] if p >= k else 0) for k in range(order, 0, -1)), of[p])
            want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 9])
def test_base_contexts_cross_reads(spark, k):
    got = {(r.context, r.base): r.n for r in blocks.context_counts(context_frame(spark), k).collect()}
    line = "ACGTACGTACGT" + "ACA" + "A" + "ANA"  # an ambiguous base with a score below 7 does not stay
    want = {}
    for i, c in enumerate(line):
        key = (("A" * k + line)[i : i + k], c)
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_read_lengths_and_lossy_texts(spark):
    got = {r.read_id: (r.raw, r.cut, r.runs, r.last) for r in blocks.read_lengths(context_frame(spark)).collect()}
    moved = lambda i, q: q + 128 + (i - 4) * 8
    assert got == {1: (12, 12, 12, 41), 2: (4, 3, 3, 2), 3: (1, 1, 1, 7), 4: (5, 4, 5, 2)} and moved(4, 0) == 128
    texts = {r.read_id: (r.lossy_sequence, r.lossy_quality) for r in blocks.lossy_texts(context_frame(spark)).collect()}
    assert texts[1] == ("ACGTACGTACGT", "".join(chr(33 + x) for x in [6, 6, 6, 6, 15, 15, 22, 27, 33, 37, 40, 40]))
    assert texts[4] == ("ANNNA", "".join(chr(33 + x) for x in [6, 0, 0, 0, 6]))


def test_blocks_close_once_over_budget(spark):
    size = [R.randrange(1, 60) for _ in range(3000)]
    rows = [(i, None if i % 3 == 2 else i % 3, n) for i, n in enumerate(size)]
    df = spark.createDataFrame(rows, "read_id long, run_id long, rec_bytes int").repartition(5)
    got = {r.read_id: r.part for r in ordered.assemble(df, 100, "run_id").collect()}
    for run in range(3):
        part = held = 0
        for i in range(run, 3000, 3):
            if held > 100:
                part, held = part + 1, 0
            held += size[i]
            assert got[i] == part
    assert ordered.assemble(df.limit(0), 100, "run_id").count() == 0
