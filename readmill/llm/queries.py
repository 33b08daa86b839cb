"""Queries of the training-data operators and what SQL can check of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm import event_runs, leaks, long_repeats, lookalike, near_duplicates, packing, splitting
from readmill.plans.runtime import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = long_repeats.shared_spans(load(spark, d, "fastq_reads"), "read_id", "sequence", 40)
    return out.select(F.col("id").alias("read_id"), F.col("shared").alias("shared_bases"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = splitting.split_records(load(spark, d, "fastq_chunks"), "chunk_id", "chunk_text", 4096, 256)
    return out.withColumnRenamed("id", "chunk_id")


def p5_balanced(spark: SparkSession, d: str) -> DataFrame:
    out = splitting.split_records(load(spark, d, "fastq_chunks"), "chunk_id", "chunk_text", 4096, 256, balanced=True)
    return out.withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = event_runs.event_runs(load(spark, d, "fastq_reads"), "read_id", "sequence", "quality", 8, 12)
    return out.withColumnRenamed("id", "read_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = near_duplicates.near_pairs(load(spark, d, "fastq_reads"), "read_id", "sequence")
    return out.select(F.col("a").alias("read_id_a"), F.col("b").alias("read_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    out = near_duplicates.near_groups(load(spark, d, "fastq_reads"), "read_id", "sequence")
    return out.select(F.col("id").alias("read_id"), "group_id", "links")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(load(spark, d, "documents"), "doc_id", "text", 2048).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    out = leaks.leaked_items(
        load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "item_text", 13
    )
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """As p9_found, with one word replaced, left out or put in among the 13."""
    out = leaks.leaked_items(
        load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "item_text", 13, 1
    )
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    out = lookalike.look_alike_pairs(load(spark, d, "documents"), "doc_id", "text")
    return out.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_members(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_members(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_text(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p5_found, p5_balanced, p6_found, p7_found, p7_groups, p8_containers, p9_found, p9_edited, p10_found, p10_members,
            p10_texts,
        )
    }


def folded_sql(column: str) -> str:
    """A text in one form per look-alike class, by composition, replacements of ligatures and a translation of single characters."""
    to = {}
    for members in lookalike.look_alike_classes():
        best = "" if "" in members else min(members, key=lookalike.preferred)
        to |= {x: best for x in members if len(x) == 1 and x != best}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # a translation deletes what has no counterpart, so those come last
    one = sorted((x for x in to if len(to[x]) < 2), key=lambda x: (to[x] == "", x))
    out = f"nfc_normalize({column})"
    for x in sorted(x for x in to if len(to[x]) > 1):
        out = f"replace({out}, {quoted(x)}, {quoted(to[x])})"
    for _ in range(2):
        out = f"nfc_normalize(translate({out}, {quoted(''.join(one))}, {quoted(''.join(to[x] for x in one))}))"
    return out


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can work off on whole tables; the others are tested against brute force."""
    looks = f"f as (select doc_id, text, {folded_sql('text')} as look from documents where text is not null)"
    return {
        "p10_found": f"""with {looks} select a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.look = b.look and a.text <> b.text and a.doc_id < b.doc_id""",
        "p10_members": f"""with {looks} select doc_id, min(doc_id) over (partition by text) as wording, min(doc_id) over (partition by look) as look_class from f""",
        "p9_found": f"""with d as (select doc_id, regexp_extract_all(lower({folded_sql("text")}), '[\\pL\\pN]+') as w from documents),
i as (select item_id, regexp_extract_all(lower({folded_sql("item_text")}), '[\\pL\\pN]+') as w from eval_items),
x as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from d),
y as (select item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from i)
select distinct doc_id, item_id from x join y using (g)""",
        "p1_found": """with r as (select distinct read_id, sequence as s from fastq_reads where length(sequence) >= 40),
k as (select read_id, a, substr(s, a, 40) as x from (select read_id, s, cast(unnest(range(1, length(s) - 38)) as int) as a from r)),
sh as (select x from k group by x having min(read_id) < max(read_id)),
f as (select read_id, a, lead(a) over (partition by read_id order by a) as nx from k join sh using (x))
select read_id, cast(sum(least(40, coalesce(nx - a, 40))) as bigint) as shared_bases from f group by read_id""",
        "p5_found": """with recursive l as (select chunk_id, unnest(range(1, len(x) + 1)) as k, unnest(x) as line, len(x) as m from
  (select chunk_id, string_split(chunk_text, chr(10)) as x from fastq_chunks where strlen(chunk_text) > 4096)),
z as (select chunk_id, (k - 1) // 4 + 1 as i, sum(strlen(line) + case when k < m then 1 else 0 end) as n from l group by chunk_id, (k - 1) // 4 having n > 0),
c as (select *, sum(n) over (partition by chunk_id order by i) as e, max(i) over (partition by chunk_id) as m from z),
f as (select a.chunk_id, a.i, any_value(a.m) as m, any_value(a.e - a.n) as s, any_value(a.n) as n, max(b.i) as j, max(b.e) - any_value(a.e - a.n) as size
  from c a join c b on b.chunk_id = a.chunk_id and b.i >= a.i and (b.e - (a.e - a.n) <= 4096 or b.i = a.i) group by a.chunk_id, a.i),
g as (select f.*, case when f.n > 4096 then f.i + 1 when j = f.m then null when j > f.i and y.n + x.n <= 4096 then j else j + 1 end as nxt
  from f join c y on y.chunk_id = f.chunk_id and y.i = f.j left join c x on x.chunk_id = f.chunk_id and x.i = f.j + 1),
w as (select * from g where i = 1 union all select g.* from w join g on g.chunk_id = w.chunk_id and g.i = w.nxt),
p as (select chunk_id, i, s + 3840 * k as a, least(4096, n - 3840 * k) as b from (select *, unnest(range(0, case when n <= 4096 then 1 else cast(ceil((n - 256) / 3840) as bigint) end)) as k from w) where n > 4096
  union all select chunk_id, i, s, size from w where n <= 4096)
select chunk_id, cast(row_number() over (partition by chunk_id order by i, a) as int) as piece_no, cast(a as bigint) as first_byte, cast(b as bigint) as n_bytes from p""",
        "p6_found": """with r as (select distinct read_id, sequence as s, quality as q from fastq_reads where sequence is not null),
c as (select read_id, unnest(range(1, length(s) + 1)) as pos, unnest(string_split(s, '')) as c from r where s <> ''),
f as (select *, coalesce(last_value(case when c not in ('N', '.') then c end ignore nulls) over w, first_value(c) over w) as k from c
  window w as (partition by read_id order by pos rows unbounded preceding)),
g as (select *, case when k is distinct from lag(k) over (partition by read_id order by pos) then 1 else 0 end as nw from f),
h as (select *, sum(nw) over (partition by read_id order by pos rows unbounded preceding) as run from g),
a as (select read_id, run, min(pos) as p, arg_min(c, pos) as first_c, count(*) as n, list(c) as cs from h group by read_id, run having count(*) >= 8),
qc as (select read_id, unnest(range(1, length(q) + 1)) as pos, unnest(string_split(q, '')) as c from r where length(q) = length(s) and q <> ''),
qg as (select *, case when abs(ascii(c) - lag(ascii(c)) over w) <= 1 then 0 else 1 end as nw from qc window w as (partition by read_id order by pos)),
qh as (select *, sum(nw) over (partition by read_id order by pos rows unbounded preceding) as run from qg),
qa as (select read_id, run, min(pos) as p, arg_min(c, pos) as first_c, count(*) as n, list(c) as cs from qh group by read_id, run having count(*) >= 12)
select read_id, 'sequence' as field_name, cast(p as int) as start_pos, cast(len(list_filter(cs, lambda v: v = first_c)) as int) as n_same, cast(n as int) as span from a
union all select read_id, 'quality', cast(p as int), cast(len(list_filter(cs, lambda v: v = first_c)) as int), cast(n as int) from qa""",
    }
