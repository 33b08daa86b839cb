"""The core queries in DuckDB's SQL, written independently of the Spark plans."""

from __future__ import annotations

_READS = "reads as (select distinct read_id, block_id, run_id, tag, sequence, plus, quality from fastq_reads)"
_POS = (
    _READS
    + """,
own as (select * from reads where length(sequence) = length(quality)),
codes as (select run_id, ascii(unnest(string_split(quality, ''))) as c from own where quality <> ''),
rng as (select run_id, min(c) as lo, max(c) as hi from codes group by run_id),
offs as (select run_id, case when hi > 74 and hi <= 105 and lo >= 64 then 64 when hi > 74 and hi <= 105 and lo >= 59 then 59
  when lo >= 33 then 33 end as off from rng),
ex as (select read_id, block_id, run_id, length(sequence) as n, unnest(range(1, length(sequence) + 1)) as pos,
  unnest(string_split(sequence, '')) as base, unnest(string_split(quality, '')) as qc from own where sequence <> ''),
p as (select read_id, block_id, ex.run_id, n, pos, base, ascii(qc) - off as q from ex join offs using (run_id)),
i as (select *, case when strpos('AGCTNRWSKMDVHBYXU.-', base) > 0 then strpos('AGCTNRWSKMDVHBYXU.-', base) - 1 end as idx from p),
k as (select *, case when idx > 3 and q < 7 then q + 128 + (idx - 4) * 8 else q end as code from i),
m as (select *, code < 128 as kept from k)"""
)
# titles cut step by step at the separators of the first title of their block
_TAG = (
    "recursive "
    + _READS
    + r""",
tp as (select block_id, regexp_extract_all(arg_min(tag, read_id), '[ ._,=:/\-#\x00]') as seps from reads where tag is not null group by block_id),
cut as (select read_id, block_id, seps, 0 as k, tag as rest, '' as field_text, '' as sep, true as ok from reads join tp using (block_id) where tag is not null
  union all select read_id, block_id, seps, k + 1, substr(rest, strpos(rest, seps[k + 1]) + 1), substr(rest, 1, strpos(rest, seps[k + 1]) - 1), seps[k + 1],
  strpos(rest, seps[k + 1]) > 0 from cut where ok and k < len(seps)),
mx as (select block_id, not bool_and(ok) as mixed from cut group by block_id),
f0 as (select read_id, block_id, k as field_no, field_text, sep from cut where k > 0 union all select read_id, block_id, k + 1, rest, '' from cut where k = len(seps)),
f as (select f0.*, case when regexp_matches(field_text, '^(0|[1-9][0-9]{0,17})$') then try_cast(field_text as bigint) end as num from f0 join mx using (block_id) where not mixed)"""
)
_RUNS = (
    _POS
    + """,
fl as (select block_id, read_id, pos, code, case when code is distinct from lag(code) over w or row_number() over w = 1 then 1 else 0 end as nw
  from m window w as (partition by block_id order by read_id, pos)),
rn as (select *, sum(nw) over (partition by block_id order by read_id, pos rows unbounded preceding) as run_no from fl),
wh as (select block_id, run_no, any_value(code) as code, count(*) as run_length from rn group by block_id, run_no),
pc as (select *, least(255, run_length - (piece_no - 1) * 255) as piece_length from
  (select *, unnest(range(1, (run_length + 254) // 255 + 1)) as piece_no from wh))"""
)


def _context(k: int) -> str:
    """Counts of the bases that stay in a block by the k bases before them."""
    before = " || ".join(f"coalesce(lag(base, {i}) over w, 'A')" for i in range(k, 0, -1))
    return f"""{_POS},
kb as (select *, {before} as context from m where kept and idx is not null window w as (partition by block_id order by read_id, pos)),
kc as (select block_id, context, base, count(*) as n from kb group by all)"""


def _quality_context(k: int, code: str) -> str:
    before = " || ',' || ".join(f"cast(coalesce(lag(x, {i}) over w, 0) as varchar)" for i in range(k, 0, -1))
    return f"""with {_POS}, y as (select *, {code} as x from m),
c as (select {before} as context, x as code, (pos - 1) * 8 // n as part from y window w as (partition by read_id order by pos))
select part, context, cast(code as bigint) as code, count(*) as n from c group by all"""


_LEN = (
    _POS
    + """,
st as (select *, case when code is distinct from lag(code) over (partition by read_id order by pos) then 1 else 0 end as nw from m),
pr as (select block_id, read_id, count(*) as raw, coalesce(max(pos) filter (where code <> 2), 1) as cut, sum(nw) as runs,
  arg_max(code, pos) as last_code from st group by block_id, read_id)"""
)
_BYTES = "strlen(tag) + strlen(sequence) + strlen(plus) + strlen(quality) + 4"
# a colour-space text decoded and encoded by window functions over its positions
_COLOUR = (
    _READS
    + """,
cr as (select read_id, sequence from reads where regexp_matches(sequence, '^[ACGT][0-3.]+$')),
cx as (select read_id, unnest(range(1, length(sequence) + 1)) as pos, unnest(string_split(sequence, '')) as c from cr),
cs as (select *, case when pos = 1 then strpos('ACGT', c) - 1 when c = '.' then 0 else cast(c as int) end as v from cx),
st as (select *, bit_xor(v) over (partition by read_id order by pos rows unbounded preceding) as s from cs),
bs as (select read_id, string_agg(case when pos = 1 then c when c = '.' then 'N' else substr('ACGT', s + 1, 1) end, '' order by pos) as bases from st group by read_id)"""
)

SQL: dict[str, str] = {
    "reads_scan": f"with {_READS} select * from reads",
    "quality_offset_infer": f"""with {_READS},
own as (select * from reads where length(sequence) = length(quality) and sequence <> ''),
codes as (select run_id, ascii(unnest(string_split(quality, ''))) as c from own),
rng as (select run_id, min(c) as min_code, max(c) as max_code from codes group by run_id),
fl as (select run_id, count(*) as n_records, bool_and(coalesce(regexp_matches(substr(sequence, 2, 1), '^[0-3.]$') and not regexp_matches(substr(sequence, 1, 1), '^[0-3]$'), null)) as color_space,
  bool_and(length(plus) > 1) as plus_repetition,
  bool_and(length(plus) > 1) = bool_or(length(plus) > 1)
   and bool_and(regexp_matches(substr(sequence, 2, 1), '^[0-3.]$')) = bool_or(regexp_matches(substr(sequence, 2, 1), '^[0-3.]$')) as consistent
  from own group by run_id),
j as (select run_id, n_records, min_code, max_code, color_space, plus_repetition, consistent,
  case when max_code > 74 and max_code <= 105 and min_code >= 64 then 64 when max_code > 74 and max_code <= 105 and min_code >= 59 then 59
  when min_code >= 33 then 33 end as quality_offset from fl join rng using (run_id))
select *, consistent and n_records > 1 and quality_offset is not null as usable from j""",
    "record_validity": f"""with {_READS} select run_id, coalesce(starts_with(tag, '@') and length(plus) > 0 and length(sequence) = length(quality), false) as valid,
count(*) as n from reads group by all""",
    "plus_regenerate": f"with {_READS} select read_id, case when length(plus) > 1 then '+' || substr(tag, 2) else '+' end as plus_line from reads where tag is not null",
    "fastq_text": f"""with {_READS} select read_id, case when starts_with(tag, '@') then tag else '@' || tag end || chr(10) || sequence || chr(10) || plus || chr(10) || quality
as record_text from reads""",
    "record_bytes": f"with {_READS} select read_id, {_BYTES} as rec_bytes from reads",
    "block_assemble": f"""with recursive {_READS}, b as (select read_id, run_id, {_BYTES} as rec_bytes from reads where tag is not null and sequence is not null and plus is not null and quality is not null),
o as (select *, row_number() over (partition by run_id order by read_id) as k from b),
a as (select run_id, k, rec_bytes, rec_bytes as size, cast(0 as bigint) as part from o where k = 1 union all select o.run_id, o.k, o.rec_bytes,
  case when a.size > 65536 then o.rec_bytes else a.size + o.rec_bytes end, case when a.size > 65536 then a.part + 1 else a.part end from a join o on o.run_id = a.run_id and o.k = a.k + 1)
select run_id, part, count(*) as n, cast(sum(rec_bytes) as bigint) as part_bytes from a group by all""",
    "chunk_records": """with l as (select chunk_id, string_split(rtrim(replace(chunk_text, chr(13) || chr(10), chr(10)), chr(10)), chr(10)) as x from fastq_chunks),
r as (select chunk_id, x, unnest(range(1, len(x) // 4 + 1)) as record_no from l)
select chunk_id, record_no, x[4 * record_no - 3] as tag, x[4 * record_no - 2] as sequence, x[4 * record_no - 1] as plus, x[4 * record_no] as quality,
starts_with(x[4 * record_no - 3], '@') and length(x[4 * record_no - 1]) > 0 and length(x[4 * record_no - 2]) = length(x[4 * record_no]) as valid from r""",
    "stream_sizes": f"""with {_READS} select run_id, cast(sum(strlen(tag)) as bigint) as tag_bytes, cast(sum(strlen(sequence)) as bigint) as sequence_bytes,
cast(sum(strlen(quality)) as bigint) as quality_bytes from reads group by run_id""",
    "block_stats": f"""with {_READS} select block_id, count(*) as n_records, cast(sum({_BYTES}) as bigint) as size_bytes, min(length(quality)) as min_length,
max(length(quality)) as max_length, min(length(quality)) <> max(length(quality)) as variable_length,
min(substr(sequence, 1, 1)) = max(substr(sequence, 1, 1)) as primer_const, case when count(distinct substr(sequence, 1, 1)) = 1 then min(substr(sequence, 1, 1)) end as primer_base
from reads group by block_id""",
    "block_meta_check": f"""with {_READS}, s as (select block_id, count(*) as c, min(length(quality)) as lo, max(length(quality)) as hi from reads group by block_id)
select m.block_id, m.records_count, coalesce(c, 0) as n_seen, coalesce(c, 0) - m.records_count as n_missing,
m.min_len is not distinct from lo and m.max_len is not distinct from hi as lengths_agree from block_meta m left join s using (block_id)""",
    "block_digest": f"""with {_READS} select block_id, md5(coalesce(string_agg(tag, '' order by read_id), '')) as tag_md5,
md5(coalesce(string_agg(sequence, '' order by read_id), '')) as sequence_md5, md5(coalesce(string_agg(quality, '' order by read_id), '')) as quality_md5 from reads group by block_id""",
    "quality_position_hist": f"with {_POS} select block_id, pos, q, count(*) as n from p group by all",
    "quality_position_hist_truncated": f"""with {_POS}, u as (select read_id, coalesce(max(pos) filter (where code <> 2), 1) as cut from m group by read_id)
select block_id, pos, cast(code as bigint) as code, count(*) as n from m join u using (read_id) where pos <= cut group by all""",
    "quality_hist": f"with {_POS} select block_id, code, count(*) as n from m group by all",
    "base_hist": f"with {_POS} select block_id, base, count(*) as n from m where kept group by all",
    "base_hist_rollup": f"with {_POS} select run_id, base, count(*) as n, cast(grouping(run_id) * 2 + grouping(base) as bigint) as level from p group by rollup (run_id, base)",
    "symbol_index": f"""with {_POS}, e as (select distinct block_id, base, idx from m where kept and idx is not null)
select block_id, base, dense_rank() over (partition by block_id order by idx) - 1 as dense, count(*) over (partition by block_id) as n_symbols from e""",
    "dna_scheme": f"""with {_POS}, c as (select block_id, count(distinct base) as n_symbols from m where kept group by block_id)
select *, case when n_symbols = 0 then 'none' when n_symbols <= 4 then 'bits2' else 'huffman' end as order_0,
case when n_symbols = 0 then 'none' when n_symbols <= 4 then 'order3_4' else 'order3_8' end as order_3,
case when n_symbols = 0 then 'none' when n_symbols <= 4 then 'order9_4' else 'order7_8' end as order_9 from c""",
    "iupac_index": f"with {_POS} select base, cast(idx as bigint) as idx, count(*) as n, substr('AGCTNRWSKMDVHBYXU.-', idx + 1, 1) as back from i group by all",
    "lossy_bin": f"""with {_POS}, h as (select q, count(*) as n from p group by q)
select q, n, case when q >= 40 then 7 when q >= 35 then 6 when q >= 30 then 5 when q >= 25 then 4 when q >= 20 then 3 when q >= 10 then 2 when q >= 2 then 1 else 0 end as bin,
case when q >= 40 then 40 when q >= 35 then 37 when q >= 30 then 33 when q >= 25 then 27 when q >= 20 then 22 when q >= 10 then 15 when q >= 2 then 6 else 0 end as stored from h""",
    "lossy_reads": f"""with {_POS} select read_id, string_agg(case when idx > 3 then 'N' else substr('AGCTNRWSKMDVHBYXU.-', idx + 1, 1) end, '' order by pos) as lossy_sequence,
string_agg(chr(33 + case when idx > 3 then 0 when q >= 40 then 40 when q >= 35 then 37 when q >= 30 then 33 when q >= 25 then 27 when q >= 20 then 22 when q >= 10 then 15 else 6 end), '' order by pos) as lossy_quality
from i group by read_id""",
    "ambiguity_transfer": f"with {_POS} select block_id, count(*) as n, cast(sum(case when kept then 0 else 1 end) as bigint) as n_moved, cast(sum(code) as bigint) as code_sum from m group by block_id",
    "ambiguity_restore": f"""with {_POS} select base, q, count(*) as n, cast(sum(case when (code - 112) // 8 + 2 = idx and (code & 7) = q then 1 else 0 end) as bigint) as n_restored
from m where idx is not null and not kept group by base, q""",
    "truncated_len": f"with {_POS} select read_id, coalesce(max(pos) filter (where code <> 2), 1) as truncated_length, count(*) as full_length from m group by read_id",
    "quality_scheme": f"""with {_LEN}, l as (select block_id, cast(sum(raw) as bigint) as raw_len, cast(sum(cut - 1) as bigint) as th_len,
cast(sum(runs) - sum(case when last_code = 2 then 1 else 0 end) as bigint) as rle_len from pr group by block_id)
select *, case when rle_len > 0 and cast(cast(th_len as float) / cast(rle_len as float) as float) > cast(1.25 as float) or rle_len = 0 and th_len > 0 then 'rle'
when th_len = 0 or cast(cast(raw_len as float) / cast(th_len as float) as float) > cast(1.10 as float) then 'truncated' else 'plain' end as scheme from l""",
    "quality_model": f"""with {_LEN}, c as (select block_id, count(distinct code) as n_codes, min(n) = max(n) as same from m group by block_id),
l as (select block_id, sum(raw) as raw_len, sum(runs) - sum(case when last_code = 2 then 1 else 0 end) as rle_len from pr group by block_id)
select block_id, n_codes, case when n_codes <= 16 then 16 when n_codes <= 32 then 32 when n_codes <= 64 then 64 else 128 end as model,
case when same and (rle_len = 0 or raw_len / rle_len > 1.175) then 'positional' else 'normal' end as kind from c join l using (block_id)""",
    "quality_runs": f"with {_RUNS} select block_id, code, piece_length, count(*) as n from pc group by all",
    "run_transitions": f"""with {_RUNS}, t as (select block_id, lag(code) over (partition by block_id order by run_no, piece_no) as previous, code from pc)
select block_id, previous, code, count(*) as n from t group by all""",
    "run_expand": f"""with {_POS}, o as (select block_id, row_number() over (partition by block_id order by read_id, pos) as ordinal, code from m)
select block_id, count(*) as n, cast(sum(ordinal * code) as bigint) as weighted from o group by block_id""",
    "dna_context_k1": f"with {_context(1)} select * from kc",
    "dna_context_k3": f"with {_context(3)} select * from kc",
    "dna_context_k9": f"with {_context(9)} select * from kc",
    "quality_context_k2": _quality_context(2, "code"),
    "quality_context_lossy_k3": _quality_context(
        3, "case when idx > 3 then 0 when q >= 40 then 7 when q >= 35 then 6 when q >= 30 then 5 when q >= 25 then 4 when q >= 20 then 3 when q >= 10 then 2 else 1 end"
    ),
    "dna_entropy_k3": f"""with {_context(3)}, t as (select *, sum(n) over (partition by block_id, context) as tt from kc)
select block_id, round(sum(-n * log2(n / tt)), 3) as bits, cast(sum(n) as bigint) as symbols from t group by block_id""",
    "quality_entropy": f"""with {_POS}, h as (select block_id, pos, code, count(*) as n from m group by all), t as (select *, sum(n) over (partition by block_id, pos) as tt from h)
select block_id, round(sum(-n * log2(n / tt)), 3) as bits, cast(sum(n) as bigint) as symbols from t group by block_id""",
    "quality_context": f"""with {_POS}, c as (select *, coalesce(lag(code) over (partition by read_id order by pos), 0) as previous, (pos - 1) * 8 // n as part from m)
select part, previous, code, count(*) as n from c group by all""",
    "colorspace_decode": f"with {_COLOUR} select * from bs",
    "colorspace_encode": f"with {_COLOUR} select read_id, sequence as colours, true as same from cr",
    "primer_strip": f"""with {_READS}, b as (select block_id, min(substr(sequence, 1, 1)) as primer from reads where sequence <> '' group by block_id having count(distinct substr(sequence, 1, 1)) = 1)
select read_id, primer, substr(sequence, 2) as rest from reads join b using (block_id) where sequence <> ''""",
    "tag_fields": f"with {_TAG} select read_id, field_no, field_text, sep, num from f",
    "tag_project": f"""with {_READS} select read_id, coalesce(r[1], '') || coalesce(r[3], '') as projected from
(select read_id, regexp_extract_all(tag, '[^ ._,=:/\\-#\\x00]*(?:[ ._,=:/\\-#\\x00]|$)') as r from reads where tag is not null)
union all select read_id, null from reads where tag is null""",
    "tag_mixed": f"""with {_TAG} select block_id, mixed, case when mixed then 'raw' else 'tokenised' end as title_coder from mx""",
    "tag_value_hist": f"""with {_TAG}, h as (select block_id, field_no, num, count(*) as n from f group by all),
g as (select block_id, field_no from f group by all having bool_and(num is not null) and count(distinct num) <= 512) select h.* from h join g using (block_id, field_no)""",
    "tag_delta_hist": f"""with {_TAG}, d as (select block_id, field_no, num - lag(num) over (partition by block_id, field_no order by read_id) as delta from f),
h as (select block_id, field_no, delta, count(*) as n from d where delta is not null group by all) select * from h qualify count(*) over (partition by block_id, field_no) <= 512""",
    "tag_length_range": f"with {_READS} select block_id, min(length(tag)) as min_len, max(length(tag)) as max_len from reads group by block_id",
    "tag_field_stats": f"""with {_TAG} select block_id, field_no, count(*) as n, min(length(field_text)) as min_len, max(length(field_text)) as max_len,
count(distinct field_text) = 1 as is_const, bool_and(num is not null) as is_num, min(num) as min_num, max(num) as max_num, count(distinct num) as n_values from f group by block_id, field_no""",
    "tag_deltas": f"""with {_TAG}, d as (select block_id, field_no, num - lag(num) over (partition by block_id, field_no order by read_id) as delta from f)
select block_id, field_no, delta, count(*) as n from d where delta is not null group by all""",
    "tag_runs": f"""with {_TAG}, g as (select *, case when num is distinct from lag(num) over w or row_number() over w = 1 then 1 else 0 end as nw from f where num is not null
window w as (partition by block_id, field_no order by read_id)), h as (select *, sum(nw) over (partition by block_id, field_no order by read_id rows unbounded preceding) as rn from g),
r as (select block_id, field_no, rn, count(*) as c from h group by all), pc as (select block_id, field_no, c, unnest(range(1, (c + 255) // 256 + 1)) as k from r)
select block_id, field_no, least(256, c - (k - 1) * 256) as piece_length, count(*) as n from pc group by all""",
    # runs by gaps and islands: a run of r repeats is stored r // 256 times, once more if another run follows or repeats are left
    "tag_scheme": f"""with {_TAG}, d as (select *, num - lag(num) over w as delta, row_number() over w as k from f window w as (partition by block_id, field_no order by read_id)),
v as (select block_id, field_no, num, k, k - row_number() over (partition by block_id, field_no, num order by k) as island from d),
vr as (select block_id, field_no, max(k) as e, count(*) - 1 as r from v group by block_id, field_no, num, island),
vn as (select block_id, field_no, sum(r // 256 + case when e < t or r % 256 > 0 then 1 else 0 end) as value_runs from (select *, max(e) over (partition by block_id, field_no) as t from vr) group by all),
x as (select block_id, field_no, delta, k, k - row_number() over (partition by block_id, field_no, delta order by k) as island from d where k > 1),
xr as (select block_id, field_no, max(k) as e, count(*) - 1 as r from x group by block_id, field_no, delta, island),
xn as (select block_id, field_no, sum(r // 256 + case when e < t or r % 256 > 0 then 1 else 0 end) as delta_runs from (select *, max(e) over (partition by block_id, field_no) as t from xr) group by all),
s as (select block_id, field_no, count(*) as n, max(num) - min(num) as value_range, max(delta) - min(delta) as delta_range,
  count(distinct num) as n_values, count(distinct delta) as n_deltas from d group by block_id, field_no having bool_and(num is not null) and count(*) > 1),
c as (select s.*, cast(value_runs as bigint) as value_runs, cast(delta_runs as bigint) as delta_runs, case when value_range < delta_range then 'value' else 'delta' end as coding,
  case when delta_range = 0 then 'delta_const' when value_range >= delta_range and n > 1.25 * delta_runs then 'delta_rle' when n > 1.25 * value_runs then 'value_rle'
   when value_range >= delta_range then 'delta_var' else 'value_var' end as scheme from s join vn using (block_id, field_no) join xn using (block_id, field_no))
select block_id, field_no, value_range, delta_range, value_runs, delta_runs, coding, scheme,
scheme = 'value_var' and value_range < 512 and n_values <= 512 or scheme = 'delta_var' and delta_range < 512 and n_deltas <= 512 as huffman,
case when least(value_range, delta_range) = 0 then 0 else length(bin(least(value_range, delta_range))) end as coded_bits,
case when value_range = 0 then 0 else length(bin(value_range)) end as value_bits from c""",
    "tag_char_hist": f"""with {_TAG}, c as (select block_id, field_no, unnest(range(1, length(field_text) + 1)) as p, unnest(string_split(field_text, '')) as symbol from f where field_text <> '')
select block_id, field_no, least(p, 129) as pos, symbol, count(*) as n from c group by all""",
    "tag_ham_mask": f"""with {_TAG}, c as (select block_id, field_no, unnest(range(1, length(field_text) + 1)) as pos, unnest(string_split(field_text, '')) as symbol from f where field_text <> ''),
n as (select block_id, field_no, count(*) as all_n from f group by all)
select block_id, field_no, pos, count(distinct symbol) = 1 and count(*) = any_value(all_n) as equal from c join n using (block_id, field_no) group by block_id, field_no, pos""",
    "tag_symbol_hist": f"with {_READS}, c as (select block_id, unnest(string_split(tag, '')) as symbol from reads where tag <> '') select block_id, symbol, count(*) as n from c group by all",
}
# The well-formed lines by the rules of the table, with regular expressions.
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
SQL["p3_found"] = f"""with l as (select raw_id, case when ends_with(coalesce(raw_line, ''), chr(13)) then left(raw_line, length(raw_line) - 1) else coalesce(raw_line, '') end as x from raw_records),
w as (select *, regexp_full_match(x, '{_FIELD}(?:,{_FIELD})*', 's') as ok from l),
f as (select *, case when ok then list_transform(regexp_extract_all(',' || x, ',({_FIELD})', 1, 's'), lambda v: case when starts_with(v, '"') then replace(substr(v, 2, length(v) - 2), '""', '"') else v end) end as v from w),
r as (select raw_id, case when not ok then 'quoting' when len(v) <> 4 then 'columns' when not starts_with(v[1], '@') then 'title'
 when not regexp_full_match(v[2], '[AGCTNRWSKMDVHBYXU.\\-]+') then 'sequence' when not starts_with(v[3], '+') then 'plus'
 when not regexp_full_match(v[4], '[!-~]*') then 'quality' when length(v[2]) <> length(v[4]) then 'length' end as reason from f)
select raw_id, reason from r where reason is not null"""
SQL["p3_records"] = SQL["p3_found"].split(",\nr as (")[0] + """
select raw_id, v[1] as title, v[2] as sequence, v[3] as plus, v[4] as quality from f where ok and len(v) = 4 and starts_with(v[1], '@')
and regexp_full_match(v[2], '[AGCTNRWSKMDVHBYXU.\\-]+') and starts_with(v[3], '+') and regexp_full_match(v[4], '[!-~]*') and length(v[2]) = length(v[4])"""
SQL["p2_found"] = r"""with r as (select distinct read_id, run_id, quality from fastq_reads where quality is not null),
k as (select *, regexp_full_match(quality, '\s*[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?([,;:|/\s]+[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?)*\s*') as is_list from r),
c as (select run_id, min(x) as lo, max(x) as hi from (select run_id, ascii(unnest(string_split(quality, ''))) as x from k where not is_list and quality <> '') group by run_id),
v as (select read_id, run_id, cast(unnest(string_split_regex(trim(quality), '[,;:|/\s]+')) as double) as x from k where is_list),
l as (select run_id, max(x) as hi, bool_and(x = floor(x)) as whole from v group by run_id),
s1 as (select v.read_id, cast(sum(floor(0.5 + case when l.hi <= 1 and not whole then -10 * log10(x) when l.hi > 41.5 then x / 10 else x end)) as bigint) as phred_sum from v join l using (run_id) group by v.read_id),
o as (select run_id, case when lo >= 33 and hi <= 74 then 33 when lo >= 59 and hi <= 100 then 59 when lo >= 64 then 64 else 33 end as off from c),
s2 as (select read_id, cast(coalesce(sum(ascii(ch) - off), 0) as bigint) as phred_sum from (select read_id, off, unnest(string_split(quality, '')) as ch from k join o using (run_id) where not is_list and off <> 33) group by read_id)
select * from s1 union all select * from s2"""
SQL["p4_found"] = r"""with r as (select distinct read_id, substr(tag, strpos(tag, ' ') + 1) as t from fastq_reads where strpos(tag, ' ') > 0),
x as (select read_id, regexp_extract_all(t || ';', '( *(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'') *|[^;,|:\t]*)[;,|:\t]', 1) as v from r),
f as (select read_id, unnest(range(1, len(v) + 1)) as pos, trim(unnest(v), ' ') as u from x),
q as (select read_id, cast(pos as int) as pos, case when regexp_full_match(u, '"(?:[^"]|"")*"') then replace(substr(u, 2, length(u) - 2), '""', '"')
 when regexp_full_match(u, '''(?:[^'']|'''')*''') then replace(substr(u, 2, length(u) - 2), '''''', '''') else u end as field_text from f)
select * from q where field_text <> ''"""
SQL["run_sets"] = f"""with {_RUNS}, ks as (select distinct block_id, 'symbol' as kind, code as value from pc union all select distinct block_id, 'length', piece_length from pc)
select block_id, kind, value, row_number() over (partition by block_id, kind order by value) - 1 as dense from ks"""
SQL["tag_delta_runs"] = f"""with {_TAG}, d as (select read_id, block_id, field_no, num - lag(num) over (partition by block_id, field_no order by read_id) as delta from f),
g as (select *, case when delta is distinct from lag(delta) over w or row_number() over w = 1 then 1 else 0 end as nw from d where delta is not null window w as (partition by block_id, field_no order by read_id)),
h as (select *, sum(nw) over (partition by block_id, field_no order by read_id rows unbounded preceding) as rn from g),
r as (select block_id, field_no, rn, count(*) as c from h group by all), pc as (select block_id, field_no, c, unnest(range(1, (c + 255) // 256 + 1)) as k from r)
select block_id, field_no, least(256, c - (k - 1) * 256) as piece_length, count(*) as n from pc group by all"""
# every record as it stands, but for the third of a chunk, whose quality line is lost
SQL["fastq_scan_damaged"] = SQL["chunk_records"].split("\nselect chunk_id")[0] + """
select x[4 * record_no - 3] as tag, x[4 * record_no - 2] as sequence, x[4 * record_no - 1] as plus, case when record_no <> 3 then x[4 * record_no] end as quality,
record_no <> 3 as valid from r"""
SQL["fastq_scan"] = f"with c as ({SQL['chunk_records']}) select tag, sequence, plus, quality, valid from c"
SQL["fastq_stream_scan"] = SQL["fastq_scan"]
SQL["fastq_round_trip"] = f"""with {_READS} select tag, sequence, plus, quality, true as valid from reads
where starts_with(tag, '@') and length(plus) > 0 and length(sequence) = length(quality)"""
SQL["archive_round_trip"] = f"""with {_READS} select read_id, tag, sequence, plus, quality, cast(0 as int) as corrupt_blocks from reads
where starts_with(tag, '@') and plus = '+' and length(sequence) = length(quality) and not regexp_matches(sequence, '^.[0-3.]')"""
