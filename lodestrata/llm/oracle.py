"""SQL for DuckDB of the training-data queries that SQL can express."""

from __future__ import annotations

from lodestrata.llm import mixing, secrets

#: How far op6 lifts the mixture's entropy towards the largest.
LIFT = 0.5


def _escaped(column: str) -> str:
    """The chat template's escaping of a column."""
    return rf"""regexp_replace(regexp_replace(replace({column}, '\', '\\'), '(<)(\||/?s>|</?sys>>)', '\1\\\2', 'gi'), '(\[)(/?inst\])', '\1\\\2', 'gi')"""


OP2 = f"""
with every as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select cast(conv_id as bigint) as conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length({_escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) + 1 + length({_escaped("text")}) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from every group by conv_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(code: int) -> str:
    name, pattern, group, least = secrets.KINDS[code]
    p = _quoted(pattern)
    return f"""
  select rid, owner, repo, {code} as kind, unnest(list_transform(range(1, len(whole) + 1), lambda i: {{'gap': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: length(w))), 0), 'size': length(whole[i]), 'value': vals[i]}})) as m, {least} as least
  from (select rid, owner, repo, regexp_split_to_array(text, {p}) as gaps, regexp_extract_all(text, {p}, 0) as whole, regexp_extract_all(text, {p}, {group}) as vals from d where regexp_matches(text, {_quoted(secrets.PRESENT.get(name, pattern))}))"""


_NAME = "case kind " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(secrets.NAMES)) + " end"
OP1 = f"""
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as text, coalesce(source, '') as owner, concat_ws('/', source, lang) as repo from documents),
raw as ({" union all ".join(_spans(i) for i in range(len(secrets.KINDS)))}),
c as (select rid, owner, repo, kind, cast(m.gap as bigint) as start, cast(m.gap + m.size as bigint) as stop, m.value as value, cast(m.gap + m.size - length(m.value) as bigint) as v_at from raw where length(m.value) >= least),
verdicts as (select value, count(distinct owner) >= {secrets.OWNERS} or count(distinct owner || chr(1) || repo) >= {secrets.REPOS} as example, bool_or(kind <> 2) and not regexp_matches(value, {_quoted(secrets.PLACEHOLDER)}) or length(value) >= 16 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and not regexp_matches(value, {_quoted(secrets.PLACEHOLDER)}) and len(list_distinct(string_split(value, ''))) >= 8 as looks from c group by value),
judged as (select c.*, looks and not example as live, example from c join verdicts v on c.value = v.value),
every as (select rid, start, kind, stop from judged union all select distinct rid, v_at, {len(secrets.KINDS)}, stop from judged where live),
sums as (select rid, string_agg({_NAME} || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans, string_agg({_NAME} || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (kind < 3) as base, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = {len(secrets.KINDS)}) as n_live from every group by rid),
examples as (select rid, count(*) filter (example) as n_example from judged group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join sums on d.rid = sums.rid left join examples on d.rid = examples.rid
"""

OP5 = """
with d as (select doc_id, row_number() over () as rid, hex(encode(coalesce(text, ''))) as h, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
w as (select rid, unnest(range(0, n - 399)) as s, unnest(list_transform(range(0, n - 399), lambda i: hash(substr(h, 2 * i + 1, 800)))) as k from d where n >= 400),
dup as (select rid, s, lag(s) over (partition by rid order by s) as before from (select rid, s, count(*) over (partition by k) as c from w) where c > 1),
islands as (select rid, s, sum(case when before is null or s > before + 400 then 1 else 0 end) over (partition by rid order by s) as g from dup),
runs as (select rid, min(s) as a, max(s) + 400 as b from islands group by rid, g),
cut as (select rid, sum(b - a) as n_removed, count(*) as n_spans, list({'a': a, 'b': b} order by a) as r from runs group by rid)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when r is null then h else array_to_string(list_transform(range(1, len(r) + 1), lambda i: substr(h, 2 * (case when i = 1 then 0 else r[i - 1].b end) + 1, 2 * (r[i].a - case when i = 1 then 0 else r[i - 1].b end))), '') || substr(h, 2 * r[len(r)].b + 1) end)) as kept_sha256
from d left join cut on d.rid = cut.rid
"""

#: All pairs: the query's links are those found by filters, which on the driver's tables are all of them.
OP4 = """
with recursive v as (select vec_id, cast(embedding as double[]) as e, embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good from embeddings),
unit as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v where good),
links as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.u) = len(b.u) where list_dot_product(a.u, b.u) >= 0.95),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a), n as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from v join c on vec_id = c.a left join n on vec_id = n.a
"""



def _dealt(salt: str, *parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('/', '{salt}', {', '.join(parts)})), 1, 15) as bigint)"


def _rounds(name: str, holds: str, pick: str) -> str:
    """Bisection in sections: CTEs that narrow (low, high) around where ``holds`` changes."""
    out = [f"{name}0 as (select cast(0.0 as double) as low, cast(1.0 as double) as high)"]
    for r in range(1, mixing.ROUNDS + 1):
        before = f"{name}{r - 1}"
        out.append(f"""{name}{r}g as (select i, low + (high - low) * i / {mixing.SECTIONS} as tau from {before}, range(0, {mixing.SECTIONS + 1}) as g(i)),
{name}{r}t as (select i, g.tau, sum(pow(p, tau)) as z, sum(pow(p, tau) * ln(p)) as l, max(pow(p, tau) / p) as high, min(pow(p, tau) / p) as low from {name}{r}g g, share group by i, g.tau),
{name}{r}i as (select {pick} as i from {name}{r}t, aim where {holds}),
{name}{r} as (select max(case when g.i = {{low}} then tau end) as low, max(case when g.i = {{high}} then tau end) as high from {name}{r}g g, {name}{r}i n)""")
    return ",\n".join(out)


_ENTROPY = _rounds("e", "-l * tau / z + ln(z) >= most - 1e-12", "coalesce(max(i), 0)").format(low="n.i", high=f"least(n.i + 1, {mixing.SECTIONS})")
_PASSES = _rounds("q", f"high / low <= {mixing.PASSES} + 1e-9", f"coalesce(min(i), {mixing.SECTIONS})").format(low="greatest(n.i - 1, 0)", high="n.i")
#: The target and the two bisections are worked out as the operator does; rows are dealt by MD5.
OP6 = f"""
with d as (select doc_id, source, tokens, concat_ws('/', source, coalesce(cast(doc_id as varchar), ''), tokens, row_number() over (partition by source, doc_id, tokens)) as name, row_number() over () as r from (
  select doc_id, coalesce(source, '') as source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) as tokens from documents)),
totals as (select source, cast(sum(tokens) as bigint) as tokens, count(*) as documents from d group by source),
share as (select tokens / sum(tokens) over () as p from totals),
aim as (select -sum(p * ln(p)) + {{lift}} * (ln(count(*)) + sum(p * ln(p))) as most from share),
{_ENTROPY},
{_PASSES},
tau as (select case when (select count(*) from totals) < 2 then 1.0 else greatest((select low from e{mixing.ROUNDS}), (select high from q{mixing.ROUNDS})) end as tau),
raw as (select source, tokens, documents, pow(cast(tokens as double), tau) as x from totals, tau),
plan as (select source, x / sum(x) over () as weight, x / tokens * (1 / min(x / tokens) over ()) as passes, cast(ceil(documents / {mixing.BLOCK}) as bigint) as blocks from raw),
dealt as (select d.*, weight, passes, cast(floor(passes + 1e-9) as integer) as whole, {_dealt("0/block", "name")} % blocks as block from d join plan on d.source = plan.source),
ordered as (select *, sum(tokens) over (partition by source, block order by {_dealt("0/order", "whole", "name")}, name, r rows unbounded preceding) - tokens / 2 as middle, sum(tokens) over (partition by source, block) as held from dealt),
numbered as (select *, whole + case when middle <= (passes - whole) * held then 1 else 0 end as n from ordered),
each as (select *, unnest(range(0, n)) as pass_no from numbered)
select doc_id, source, tokens as n_tokens, round(weight, 6) as weight, block, cast(pass_no as integer) as pass_no, {_dealt("0/place", "pass_no", "name")} as place from each
"""

#: Every anchor against every row. Rows of equal ids and scores give equal results, so their order is free.
OP11 = """
with rows as (
    select row_number() over () as r, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  scored as (
    select a.r as a, a.id as anchor_id, b.r as b, b.id as id, a.label = b.label as same, cast(list_sum(list_transform(range(1, 1 + greatest(len(a.q), len(b.q))), lambda i: coalesce(a.q[i], 0) * coalesce(b.q[i], 0))) as bigint) as score
    from rows a join rows b on a.id % 100 = 0 and a.r <> b.r),
  positives as (select * from (select *, row_number() over (partition by a order by score desc, id nulls last, b) as p from scored where same) where p <= 5),
  ranked as (
    select p.a, p.p, p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score, row_number() over (partition by p.a, p.p order by n.score desc, n.id nulls last, n.b) as rank
    from positives p join scored n on n.a = p.a and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
  select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""

#: Prefixes are strings of their turns' digests; CRC-32 is worked out bit by bit.
OP13 = """
with own as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
    from conversations where conv_id is not null),
  crc as (select c, list_reduce(list_transform(range(length(c::varchar) + 1), lambda i: case when i = 0 then 4294967295 else ascii(substr(c::varchar, i, 1)) end),
      lambda s, b: list_reduce(list_transform(range(9), lambda i: case when i = 0 then xor(s::bigint, b::bigint) else 0 end), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as r
    from (select distinct c from own)),
  heads as (select c, xor(r::bigint, 4294967295) % 6 as h from crc),
  n_base as (select h.c, h.h, (select count(*) from own o where o.c = h.c - h.c % 100 and o.pos <= h.h) as m from heads h),
  turns as (
    select n.c, o.pos as d, o.role, o.text from n_base n join own o on o.c = n.c - n.c % 100 and o.pos <= n.h
    union all select n.c, n.m + o.pos - n.h, o.role, o.text from n_base n join own o on o.c = n.c and o.pos > n.h),
  steps as (select c, d, length(text) as n, string_agg(md5(length(role) || ':' || role || text), '') over (partition by c order by d) as path from turns union all select c, 0, 0, '' from heads),
  ends as (select path, sha256(string_agg(c::varchar, ',' order by c)) as sha from (select c, path from (select c, path, row_number() over (partition by c order by d desc) as k from steps) where k = 1) group by path),
  nodes as (select d, path, min(c) as conv_id, count(*) as n, any_value(n) as size, left(path, 32 * (d - 1)::integer) as up from steps group by d, path),
  kids as (select up, count(*) as n from nodes where d > 0 group by up),
  below as (select left(path, 32 * i::integer) as path, sum((n - 1) * size) as saved, sum(leaf) as leaves from (
    select v.path, v.n, v.size, case when k.n is null then 1 else 0 end as leaf, unnest(range(v.d + 1)) as i from nodes v left join kids k on k.up = v.path) group by 1)
  select v.conv_id, v.d as depth, p.conv_id as parent_conv_id, v.n as n_convs, coalesce(k.n, 0) as n_children, cast(b.leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
  from nodes v join below b on b.path = v.path left join nodes p on v.d > 0 and p.path = v.up left join kids k on k.up = v.path left join ends e on e.path = v.path
"""

SQL = {"op1_secret_scans": OP1, "op2_chat_formatting": OP2, "op4_embedding_dedup": OP4, "op5_suffix_dedup": OP5, "op6_source_mixing": OP6.format(lift=LIFT), "op11_hard_negatives": OP11, "op13_prefix_trie": OP13}
