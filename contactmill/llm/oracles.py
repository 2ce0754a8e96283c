"""DuckDB SQL for the rows of queries.py, where SQL can express them."""

from __future__ import annotations

from . import chat_format, mixing, rule_ledger, secret_index, vector_codes

_WS = r"[^\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _mix() -> str:
    n, w, b = mixing.MAX_COPIES, mixing.WEIGHTS, mixing.RANK_BUCKETS
    weight = "case (row_number() over (order by source nulls last) - 1) % {} {} end".format(len(w), " ".join(f"when {i} then {x}" for i, x in enumerate(w)))
    return f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WS}+'))::bigint as size,
         md5('mix|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as key from documents),
e as (select *, ceil(sqrt(size))::bigint as m from d),
s0 as (select source, sum(size)::bigint as source_size from e group by source),
s1 as (select *, ({weight})::bigint as w from s0),
s2 as (select *, sum(source_size) over ()::bigint as total, sum(source_size) over (order by source_size / w)::bigint as below,
              (sum(w) over () - sum(w) over (order by source_size / w))::bigint as w_above from s1),
s3 as (select *, {n} * (w * below + source_size * w_above) <= total * w as fl from s2),
s4 as (select *, total - {n} * coalesce(sum(source_size) filter (where fl) over (), 0)::bigint as lft, (sum(w) filter (where not fl) over ())::bigint as w_left from s3),
t as (select source, source_size, case when fl then ({n} * source_size)::double else (lft * w)::double / w_left::double end as target from s4),
m0 as (select source, m, sum(size)::bigint as words from e group by source, m),
m1 as (select m0.*, t.target, sum(words) over (partition by m0.source order by m desc)::bigint as c,
              (sum(m * words) over (partition by m0.source) - sum(m * words) over (partition by m0.source order by m desc))::bigint as r
       from m0 join t on m0.source is not distinct from t.source),
m2 as (select *, m > 0 and {n} * (m * c + r) <= target * m as lim from m1),
k as (select source, max(target) as target, (max(target) - {n} * coalesce(sum(words) filter (where lim), 0)::bigint) / nullif(sum(m * words) filter (where not lim), 0)::bigint as k from m2 group by source),
x as (select e.*, t.source_size, k.target,
             case when k.k is null then case when k.target > 0 then {n}.0::double else 0.0::double end else least({n}.0::double, k.k * e.m) end as ex
      from e join k on e.source is not distinct from k.source join t on e.source is not distinct from t.source),
c as (select source, max(target) - sum(floor(ex)::bigint * size)::bigint as lacks from x group by source),
q as (select x.*, c.lacks, ex - floor(ex) as p, ((('0x' || substr(key, 1, 13))::bigint)::double + 0.5) / 4503599627370496.0::double as u from x join c on x.source is not distinct from c.source),
o as (select *, case when size > 0 and p > 0 then (u * (1.0::double - p)) / ((1.0::double - u) * p) end as q from q),
g as (select *, coalesce(sum(case when q is not null then size end) over (partition by source order by q, key rows between unbounded preceding and 1 preceding), 0)::bigint as before from o)
select doc_id, size, source_size, target, case when size = 0 then 0 else (floor(ex)::bigint + case when q is not null and before + size / 2.0::double <= lacks then 1 else 0 end) * size end::bigint as taken from g"""


def _ledger() -> str:
    conditions = " | ".join(f"(case when {cond} then {1 << i} else 0 end)" for i, (_, cond) in enumerate(rule_ledger.RULES))
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{_WS}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WS}')) as ls from d),
p as (select r, ws, unnest(range(1, len(ws) - 1)) as i from w),
g as (select r, list(i) as places from p group by r, ws[i], ws[i + 1], ws[i + 2] having count(*) > 1),
h as (select r, count(distinct j)::bigint as n from (select r, unnest([i, i + 1, i + 2]) as j from (select r, unnest(places) as i from g)) group by r),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines from w left join h using (r)),
f as (select *, ({conditions})::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {rule_ledger.BASE.mask} <> 0 as base_failed,
       failed & {rule_ledger.BASE.mask | rule_ledger.DEFAULT.mask} = 0 as kept, failed from f"""


def _secrets() -> str:
    parts = []
    for i, rule in enumerate(secret_index.RULES):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""select r, {i} as o, '{rule.kind}' as kind, {str(rule.base).lower()} as base, s, s + length(m[k]) as e from (
  select r, m, g, k, (list_sum(list_transform(p[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0))::bigint as s from (
    select r, string_split_regex(t, {p}) as p, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {rule.group}) as g,
           unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) as k from d)) where length(g[k]) >= {rule.least}""")
    text = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"coalesce(sum((o = {i})::int), 0)::bigint as n_{r.kind}" for i, r in enumerate(secret_index.RULES) if r.base)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join(parts)}),
a as (select r, {counts}, string_agg({text}, ',' order by s, o) filter (where base) as b, string_agg({text}, ',' order by s, o) as spans from s group by r)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secret_index.RULES if r.base)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (r)"""


def _winnow() -> str:
    return rf"""
with b as (select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where item_id is not null and text is not null),
i as (select item_id, ws, len(ws) as n, case when len(ws) < 13 then len(ws) else 13 end as k from b where len(ws) > 0),
iw as (select distinct item_id, k, array_to_string(ws[j:j + k - 1], ' ') as gram from (select *, unnest(range(1, n - k + 2)) as j from i)),
d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
dw as (select r, k, j, array_to_string(ws[j:j + k - 1], ' ') as gram from (select r, ws, k, unnest(range(1, len(ws) - k + 2)) as j from d, (select distinct k from i))),
h as (select r, k, j, item_id from dw join iw using (k, gram)),
n as (select r, count(distinct w)::bigint as n_hit from (select r, unnest(range(j, j + k)) as w from h) group by r),
t as (select r, count(*)::bigint as n_items, string_agg(x, ',' order by x) as ids from (select distinct r, item_id::varchar as x from h) group by r),
o as (select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256 from d left join n using (r) left join t using (r))
select *, n_hit > 0 and 20 * n_hit >= n_words as contaminated from o"""


def near_dup(k: int = 2, percent: int = 80, table: str = "documents") -> str:
    """CTE text that ends in `near`: (r, doc_id, n_shingles, component_id) of the rows of a table."""
    return f"""
d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WS}+') as ws from {table}),
sh as (select r, doc_id, case when len(ws) = 0 then [] when len(ws) < {k} then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) end as s from d),
g as (select r, len(s)::bigint as n, unnest(s) as x from sh),
pr as (select a.r as a, b.r as b, any_value(a.n) as na, any_value(b.n) as nb, count(*)::bigint as c from g a join g b on a.x = b.x and a.r < b.r and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by a.r, b.r),
ln as (select a, b from pr where 100 * c >= {percent} * (na + nb - c)),
ed as (select a, b from ln union all select b, a from ln),
reach as (select r as a, r as b from d union select reach.a, ed.b from reach join ed on reach.b = ed.a),
near as (select sh.r, sh.doc_id, len(s)::bigint as n_shingles, component_id from sh join (select reach.a as r, min(d.doc_id) as component_id from reach join d on d.r = reach.b group by reach.a) c using (r))"""


def _line_runs(min_words: int = 50) -> str:
    """Lines of later copies of runs that get shorter than min_words without their first or without their last line."""
    return f"""
with d as (select doc_id, coalesce(doc_id, 9223372036854775807) as did, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint as dk,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WS}')) as ls from documents),
u as (select did, dk, any_value(ls) as ls from d group by did, dk),
l as (select did, dk, pos, line, len(regexp_extract_all(line, '{_WS}+')) as nw from (select did, dk, unnest(range(len(ls))) as pos, unnest(ls) as line from u)),
s as (select *, sum(nw) over (partition by did, dk order by pos) as total from l),
w as (select a.did, a.dk, a.pos, b.pos - a.pos + 1 as w from s a join s b on a.did = b.did and a.dk = b.dk and b.pos >= a.pos and b.pos < a.pos + {min_words} and b.total - a.total + a.nw >= {min_words} and (b.total - a.total < {min_words} or b.total - a.total + a.nw - b.nw < {min_words})),
x as (select w.*, array_to_string(ls[pos + 1:pos + w], chr(10)) as run from w join u using (did, dk)),
f as (select *, row_number() over (partition by run order by did, dk, pos) as n from x),
g as (select distinct did, dk, unnest(range(pos, pos + w)) as pos from f where n > 1),
i as (select did, dk, pos, pos - row_number() over (partition by did, dk order by pos) as island from g),
r as (select did, dk, island, min(pos) as a, max(pos) as b from i group by all),
t as (select did, dk, sum(b - a + 1)::bigint as n_deleted, count(*)::bigint as n_runs, string_agg(a || '-' || b, ',' order by a) as runs from r group by all)
select doc_id, len(ls)::bigint as n_lines, coalesce(n_deleted, 0) as n_deleted, coalesce(n_runs, 0) as n_runs, coalesce(runs, '') as runs from d left join t using (did, dk)"""


def _codes() -> str:
    """The rounds unrolled; whole numbers from the start."""
    m, k, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE
    usable = f"embedding is not null and len(embedding) > 0 and len(embedding) % {m} = 0 and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false)"
    floor = "case when s >= 0 then s // n else -((-s + n - 1) // n) end"
    parts = [f"""
e as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, embedding from embeddings where {usable}),
v as (select r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from e where len(embedding) = (select len(embedding) from e where r = 1)),
x as (select r, p, x[p * (len(x) // {m}) + 1:(p + 1) * (len(x) // {m})] as x from v, range({m}) t(p)),
b0 as (select p, r - 1 as k, x as c from x where r <= {k})"""]
    near = "select r, p, arg_min(k, (d, k)) as k, min(d) as d from (select r, x.p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join {} b on x.p = b.p) group by r, p"
    for i in range(vector_codes.ROUNDS):
        parts.append(f"""a{i} as ({near.format(f"b{i}")}),
m{i} as (select p, k, list(v order by j) as c from (select p, k, j, {floor} as v from (select a.p, a.k, j, sum(x[j])::bigint as s, count(*) as n from a{i} a join x using (r, p), range(1, (select max(len(x)) + 1 from x)) t(j) group by a.p, a.k, j)) group by p, k),
b{i + 1} as (select p, k, coalesce(m.c, b.c) as c from b{i} b left join m{i} m using (p, k))""")
    last = f"b{vector_codes.ROUNDS}"
    parts.append(f"""f as ({near.format(last)}),
o as (select r, string_agg(printf('%02x', k), '' order by p) as code, sum(d)::bigint as error from f group by r),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) as codebooks_sha256 from {last})""")
    return "with " + ",\n".join(parts) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join o using (r), h"


def _chat(template: chat_format.Template = chat_format.DEFAULT) -> str:
    clean = f"regexp_replace({{}}, '{template.pattern}', '\\1\\\\\\2\\3', 'g')"
    role = clean.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, length({role}) + length({clean.format("text")}) + {len(template.open) + len(template.close) + 2} as n, role = '{template.target}' as hit from t),
c as (select *, sum(n) over (partition by conv_id order by turn nulls last, role, text rows unbounded preceding) as cum from n)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where hit), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where hit), '')) as loss_sha256,
  (coalesce(sum(cum) filter (where hit), 0) + max(cum) - coalesce(max(cum) filter (where hit), 0))::bigint as formatted_chars, count(*) filter (where hit) as n_examples from c group by conv_id"""


SQL = {
    "op1_pareto_mix": _mix(),
    "op5_setsketch": f"with recursive {near_dup()}\nselect doc_id, n_shingles, component_id, (doc_id is not distinct from component_id) as kept from near",
    "op6_rule_ledger": _ledger(),
    "op7_line_runs": _line_runs(),
    "op8_trigram_secrets": _secrets(),
    "op10_winnowing": _winnow(),
    "op12_vector_codes": _codes(),
    "op13_prefix_targets": _chat(),
}
