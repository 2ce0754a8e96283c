"""Names, keys, merges, address patterns and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.functions import text as t_
from contactmill.operators import dedupe, fuzzy, matching, patterns

from .base import Tables, query


def _sql_cut_end(column: str, suffixes: tuple[str, ...]) -> list[str]:
    """CTEs c0, c1, ... each of which tries one suffix on column `v` of the one before."""
    return [f"c{i + 1} as (select * replace (case when ends_with(v, '{s}') then trim(left(v, length(v) - {len(s)})) else v end as v) from c{i})" for i, s in enumerate(suffixes)]


def _sql_cut_start(n: int, prefixes: tuple[str, ...]) -> list[str]:
    return [f"c{n + i + 1} as (select * replace (case when starts_with(v, '{s}') then trim(substr(v, {len(s) + 1})) else v end as v) from c{n + i})" for i, s in enumerate(prefixes)]


_FUND = "with c0 as (select p_partkey, lower(trim(p_name || ' ' || (case p_partkey % 4 when 0 then 'Capital Partners' when 1 then 'Ventures' when 2 then 'Fund LLC' else 'Group Inc.' end))) as v from part), " + ", ".join(_sql_cut_end("v", t_.FUND_SUFFIXES))


def _funds(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 4 == 0, "Capital Partners").when(F.col("p_partkey") % 4 == 1, "Ventures").when(F.col("p_partkey") % 4 == 2, "Fund LLC").otherwise("Group Inc.")
    return t.part.select("p_partkey", "p_name", "p_brand", F.concat_ws(" ", "p_name", tail).alias("fund"))


@query(f"{_FUND} select p_partkey, v as fund from c{len(t_.FUND_SUFFIXES)}")
def normalize_fund(t: Tables) -> DataFrame:
    """P2."""
    return _funds(t).select("p_partkey", t_.normalize_fund(F.col("fund")).alias("fund"))


_NAME = (
    "with d as (select doc_id, 'Dr. ' || split_part(text, chr(10), 1) || ' Jr.' as n from documents), c0 as (select doc_id, lower(trim(strip_accents(n))) as v from d), "
    + ", ".join([*_sql_cut_start(0, t_.TITLES), *[x.replace(f"c{i + 1} as", f"c{i + 1 + len(t_.TITLES)} as").replace(f"from c{i})", f"from c{i + len(t_.TITLES)})") for i, x in enumerate(_sql_cut_end("v", t_.CREDENTIALS))]])
    + f", w as (select doc_id, list_filter(string_split_regex(trim(v), '\\s+'), lambda x: x <> '') as p from c{len(t_.TITLES) + len(t_.CREDENTIALS)}) select doc_id, array_to_string(case when len(p) > 2 then list_filter(p, lambda x: not regexp_matches(x, '^\\p{{L}}\\.?$')) else p end, ' ') as name from w"
)


@query(_NAME)
def normalize_name_ascii(t: Tables) -> DataFrame:
    """P1, P4."""
    return t.documents.select("doc_id", t_.normalize_name(F.concat(F.lit("Dr. "), F.substring_index("text", "\n", 1), F.lit(" Jr."))).alias("name"))


@query(f"{_FUND} select p_partkey, md5(lower(trim(p_name)) || '|' || v) as key from c{len(t_.FUND_SUFFIXES)} join part using (p_partkey)")
def dedupe_key(t: Tables) -> DataFrame:
    """P3."""
    return _funds(t).select("p_partkey", t_.merge_key(t_.normalize_name_plain(F.col("p_name")), t_.normalize_fund(F.col("fund"))).alias("key"))


_STATUS = "case l_returnflag when 'R' then 'verified' when 'A' then 'scraped' else 'guessed' end"


@query(f"""with r as (select *, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as seq, {_STATUS} as st, case when l_returnflag <> 'N' or l_linenumber > 2 then 'p' || l_partkey || '@x.test' end as em, case when l_tax > 0.04 then l_linestatus end as li from lineitem),
b as (select *, case when em is not null then row_number() over (partition by l_orderkey, em is null order by case st when 'verified' then 5 when 'scraped' then 4 else 2 end desc, seq) end as rn from r)
select l_orderkey, min_by(li, seq) filter (where li is not null) as linkedin, count(*) as times_seen, min(l_shipdate)::date::varchar as first_seen, max(l_shipdate)::date::varchar as last_seen, max(em) filter (where rn = 1) as email, max(st) filter (where rn = 1) as email_status from b group by l_orderkey""")
def merge_fold(t: Tables) -> DataFrame:
    """Rows of a key folded into one."""
    status = F.when(F.col("l_returnflag") == "R", "verified").when(F.col("l_returnflag") == "A", "scraped").otherwise("guessed")
    email = F.when((F.col("l_returnflag") != "N") | (F.col("l_linenumber") > 2), F.concat(F.lit("p"), "l_partkey", F.lit("@x.test")))
    rows = t.lineitem.select("l_orderkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"), status.alias("email_status"), email.alias("email"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("linkedin"), "l_shipdate")
    out = dedupe.fold(rows, ["l_orderkey"], "seq", ["linkedin"], email="email", status="email_status", seen="l_shipdate")
    return out.withColumns({c: F.col(c).cast("date").cast("string") for c in ("first_seen", "last_seen")})


@query("""with a as (select doc_id, md5(text) as h, case when n_chars % 2 = 0 then source || n_chars end as e from documents), b as (select *, row_number() over (partition by h order by doc_id) as rn from a), c as (select *, row_number() over (partition by e order by doc_id) as r2 from b where rn = 1)
select doc_id, e as email from c where e is null or r2 = 1""")
def two_level_dedupe(t: Tables) -> DataFrame:
    """W2."""
    rows = t.documents.select("doc_id", F.md5("text").alias("h"), F.when(F.col("n_chars") % 2 == 0, F.concat("source", "n_chars")).alias("email"))
    return dedupe.two_level(rows, ["h"], "email", "doc_id").select("doc_id", "email")


@query("""select c_custkey, coalesce(n.b, c_acctbal) as balance, n.b is not null as updated from customer left join (select o_custkey, arg_max(o_totalprice, o_orderkey) as b from orders where o_orderstatus = 'P' group by 1) n on c_custkey = o_custkey
union all select 1000000 + s_suppkey, s_acctbal, true from supplier where s_suppkey < 5""")
def lead_upsert(t: Tables) -> DataFrame:
    """K3, K4, D5."""
    current = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(False).alias("updated"))
    changes = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), F.lit(True).alias("updated"), (-F.col("o_orderkey")).alias("o"))
    more = t.supplier.where("s_suppkey < 5").select((1_000_000 + F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("balance"), F.lit(True).alias("updated"), F.lit(0).cast("long").alias("o"))
    return dedupe.upsert(current, changes.union(more), ["c_custkey"], ["balance", "updated"], "o").select("c_custkey", "balance", "updated")


def _people(t: Tables) -> DataFrame:
    parts = F.split("p_name", " ")
    return t.part.select(F.col("p_partkey").alias("seq"), F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("last"), F.concat(F.lower(F.replace("p_brand", F.lit("#"))), F.lit(".test")).alias("domain"))


_PEOPLE = "p as (select p_partkey as seq, split_part(p_name, ' ', 1) as fi, split_part(p_name, ' ', 2) as la, lower(replace(p_brand, '#', '')) || '.test' as dom from part)"
_SHAPES = [
    ("{first}.{last}@{domain}", "fi || '.' || la"), ("{first}@{domain}", "fi"), ("{f}{last}@{domain}", "fi[1] || la"), ("{first}{last}@{domain}", "fi || la"),
    ("{f}.{last}@{domain}", "fi[1] || '.' || la"), ("{last}@{domain}", "la"), ("{first}_{last}@{domain}", "fi || '_' || la"), ("{last}.{first}@{domain}", "la || '.' || fi"),
]
_CAND = "cand as (" + " union all ".join(f"select seq, dom, {i} as n, '{p}' as pattern, {e} || '@' || dom as email from p" for i, (p, e) in enumerate(_SHAPES)) + ")"


@query(f"with {_PEOPLE}, {_CAND} select seq, case when seq % 10 = 0 then null else pattern end as pattern, case when seq % 10 = 0 then 'own@x.test' else email end as email from cand where seq % 10 <> 0 or n = 0")
def pattern_candidates(t: Tables) -> DataFrame:
    """G1, G2, X2."""
    own = F.col("seq") % 10 == 0
    rows = _people(t).withColumns({"email": F.when(own, "own@x.test"), "email_status": F.when(own, "verified").otherwise("unknown")})
    return patterns.expand(rows, "first", "last", "domain").select("seq", "pattern", "email")


def _observed(t: Tables) -> DataFrame:
    people = _people(t)
    c = patterns.candidates(F.col("first"), F.col("last"), F.col("domain"))
    return people.withColumn("email", F.get(c, (F.col("seq") % 3).cast("int"))["email"]).withColumn("pattern", patterns.detect(F.col("email"), F.col("first"), F.col("last")))


_OBS = "obs as (select c.seq, c.dom as domain, min_by(c.pattern, c.n) as pattern from cand c join cand o on c.seq = o.seq and o.n = o.seq % 3 and o.email = c.email group by all)"
_LEARN = "cnt as (select domain, pattern, count(*) as n, min(seq) as f from obs group by all), best as (select domain, pattern, n as best, sum(n) over (partition by domain)::bigint as total, row_number() over (partition by domain order by n desc, f) as rn from cnt)"


@query(f"with {_PEOPLE}, {_CAND}, {_OBS}, {_LEARN} select domain, pattern, best, total from best where rn = 1")
def pattern_detect_learn(t: Tables) -> DataFrame:
    """G3, A13."""
    return patterns.learn(_observed(t))


@query(f"with {_PEOPLE}, {_CAND}, {_OBS} select pattern, count(*) as n, count(distinct domain) as domains, round(count(*)::double / sum(count(*)) over (), 3) as share from obs group by pattern")
def pattern_statistics(t: Tables) -> DataFrame:
    """A15."""
    return patterns.statistics(_observed(t))


@query(f"""with {_PEOPLE}, {_CAND}, {_OBS}, d as (select domain, pattern, count(*) as n, min(seq) as first from obs group by all), g as (select domain, arg_max(pattern, (n, -first)) as pattern, max(n) as best, sum(n)::bigint as n, min(first) as first from d group by domain)
select * from (select 'group' as level, domain, pattern, n, null::bigint as groups, round(best / n::double, 3) as share from g order by n desc, first limit 50)
union all select 'value', null, pattern, count(*), null, round(count(*) / sum(count(*)) over ()::double, 3) from obs group by pattern
union all select 'total', null, null, count(*), count(distinct domain), 1.0::double from obs""")
def pattern_levels(t: Tables) -> DataFrame:
    """Patterns in all, over all domains, and of the fifty domains of most observations, in one pass."""
    return patterns.levels(_observed(t), "domain", "pattern", "seq")


@query(f"""with {_PEOPLE}, {_CAND}, {_OBS}, {_LEARN}, l as (select domain, pattern as lp, case when total >= 2 and best / total >= 0.67::double then 'domain_lock' else 'domain_hint' end as source from best where rn = 1 and domain not like '%1.test'),
s as (select seq, c.pattern, email, coalesce(source, 'base_rate') as source, round(case when c.pattern is not distinct from lp then case source when 'domain_lock' then 0.90::double when 'domain_hint' then 0.72::double end else 0.1::double * 0.6::double end * case when seq % 4 = 0 then 0.3::double else 1.0::double end, 4) as score from cand c left join l on c.dom = l.domain)
select seq, pattern, email, source, score, case when score >= 0.75 then 'HIGH' when score >= 0.4 then 'MEDIUM' else 'LOW' end as tier, rn::bigint as rank from (select *, row_number() over (partition by seq order by score desc, pattern desc, email desc) as rn from s) where rn <= 2""")
def pattern_confidence(t: Tables) -> DataFrame:
    """A16, C16, W4, X1."""
    learned = patterns.learn(_observed(t)).where("domain not like '%1.test'")
    learned = learned.select("domain", F.col("pattern").alias("lp"), "best", "total")
    rows = patterns.expand(_people(t).withColumns({"email": F.lit(None).cast("string"), "email_status": F.lit("unknown")}), "first", "last", "domain").join(learned, "domain", "left")
    source = patterns.confidence(F.col("total"), F.col("best"))["source"]
    rows = rows.withColumn("source", source).withColumn("score", patterns.candidate_score(F.col("pattern"), F.col("lp"), F.col("source"), F.lit(0.1), F.col("seq") % 4 != 0))
    return patterns.top(rows, ["seq"]).select("seq", "pattern", "email", "source", "score", patterns.confidence_tier(F.col("score")).alias("tier"), "rank")


_RATE = "case c.pattern " + " ".join(f"when '{k}' then {v}" for k, v in patterns.BASE_RATES.items()) + " end::double"


@query(f"""with {_PEOPLE}, {_CAND}, {_OBS}, {_LEARN}, l as (select domain, pattern as lp, case when total >= 2 and best / total >= 0.67::double then 'domain_lock' else 'domain_hint' end as source, case when total >= 2 and best / total >= 0.67::double then least(0.92::double, 0.70::double + 0.10::double * total) else least(0.75::double, 0.50::double + 0.08::double * total) end as conf from best where rn = 1 and domain in (select min(dom) over (partition by length(dom)) from p)),
q as (select p.*, coalesce(lp, '{patterns.COMMONEST}') as lp, coalesce(source, 'base_rate') as source, coalesce(conf, 0.41::double) as conf, seq % 5 <> 0 as mx, case seq % 6 when 0 then la || '@' || dom when 1 then 'zz@' || dom end as own from p left join l on p.dom = l.domain),
s as (select q.dom, q.seq, conf, c.pattern, c.email, source, round(case when c.pattern = lp then case source when 'domain_lock' then 0.90::double when 'domain_hint' then 0.72::double else {_RATE} end else {_RATE} * 0.6::double end * case when mx then 1.0::double else 0.3::double end, 4) as score from q join cand c on c.seq = q.seq where own is null),
r as (select *, row_number() over (partition by seq order by score desc, pattern desc, email desc) as rank from s),
a as (select dom, seq, conf, pattern, email, source, score, rank from r where rank <= 2 union all
  select dom, seq, conf, case when seq % 6 = 1 then 'other' else '{{last}}@{{domain}}' end, own, 'scraped', case when mx then least(0.98::double, conf + 0.15::double) else 0.6::double end, 1 from q where own is not null)
select dom as domain, seq, conf as confidence, pattern, email, source, score, rank::bigint as rank, case when score >= 0.75 then 'HIGH' when score >= 0.4 then 'MEDIUM' else 'LOW' end as tier from a""")
def ranked_addresses(t: Tables) -> DataFrame:
    """Likeliest addresses with the confidence in each domain's pattern; scraped ones pass through."""
    people = _people(t)
    lowest = people.groupBy(F.length("domain").alias("n")).agg(F.min("domain").alias("domain"))
    learned = patterns.learn(_observed(t)).join(lowest.select("domain"), "domain", "left_semi")
    own = F.when(F.col("seq") % 6 == 0, F.concat("last", F.lit("@"), "domain")).when(F.col("seq") % 6 == 1, F.concat(F.lit("zz@"), "domain"))
    seen = people.select("domain", "seq", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.concat(F.lit("old@"), "domain").alias("email")), F.struct(F.lit(1).alias("pos"), own.alias("email")))).alias("x")).select("domain", "seq", "x.*")
    scraped = matching.last_by_key(seen.where("seq % 6 < 2"), ["domain", "seq"], "pos", "email")
    return patterns.rank_addresses(people.withColumn("has_mx", F.col("seq") % 5 != 0), learned, scraped)


@query(f"""with {_PEOPLE}, {_CAND} select c.seq, c.pattern, case when split_part(email, '@', 1) = fi || '.' || la then 1.0::double when split_part(email, '@', 1) = fi then 0.8::double when split_part(email, '@', 1) = fi || la then 0.9::double when split_part(email, '@', 1) in (fi[1] || la, fi[1] || '.' || la) then 0.85::double
when split_part(email, '@', 1) = la then 0.6::double when split_part(email, '@', 1) = fi || '_' || la then 0.9::double when split_part(email, '@', 1) = la || '.' || fi then 0.8::double else 0.0::double end as score from cand c join p using (seq)""")
def email_name_match(t: Tables) -> DataFrame:
    """P19."""
    rows = patterns.expand(_people(t).withColumns({"email": F.lit(None).cast("string"), "email_status": F.lit("unknown")}), "first", "last", "domain")
    return rows.select("seq", "pattern", t_.email_name_score(F.col("email"), F.col("first"), F.col("last")).alias("score"))


@query("""with k as (select distinct p_brand, p_name || ' ' || p_size as name, min(p_partkey) over (partition by p_brand, p_name || ' ' || p_size) as o from part)
select a.name as left_name, b.name as right_name, a.o as lo, levenshtein(a.name, b.name)::bigint as distance from k a join k b on a.p_brand = b.p_brand and a.o < b.o where levenshtein(a.name, b.name) <= 2""")
def fuzzy_dedupe(t: Tables) -> DataFrame:
    """J17 by edits: near-equal names of one brand."""
    rows = t.part.select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    out = fuzzy.similar_pairs(rows, "name", "p_partkey", ["p_brand"])
    return out.select(F.col("left").alias("left_name"), F.col("right").alias("right_name"), "lo", "distance")


@query()
def fuzzy_ratio(t: Tables) -> DataFrame:
    """Each name with the first accepted one that it is merged into, at a ratio of matching blocks of 0.95."""
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_brand"), F.col("p_size").cast("string")).alias("name"))
    return fuzzy.merge_similar(rows, "name", "p_partkey").select("p_partkey", "merged_key")


_SHOWN = """s as (select distinct dom, fi[1] || la as x from p where seq % 3 <> 0),
j as (select p.dom, seq, x || '@' || p.dom as email, case when fi = '' or la = '' then 0 when x = fi || '.' || la then 1 when x = fi then 0.8 when x = fi || la then 0.9 when x in (fi[1] || la, fi[1] || '.' || la) then 0.85
when x = la then 0.6 when x = fi || '_' || la then 0.9 when x = la || '.' || fi then 0.8 when contains(x, fi) and contains(x, la) then 0.7 when contains(x, fi) then 0.4 when contains(x, la) then 0.5 else 0 end::double as score from p join s using (dom))"""


@query(f"""with recursive {_PEOPLE}, {_SHOWN}, l as (select dom, seq, list(email order by score desc, email) as wish from j where score >= 0.3 group by all),
o as (select *, row_number() over (partition by dom order by seq) as n from l),
g as (select dom, 0::bigint as n, null::bigint as seq, null::varchar as email, []::varchar[] as used from (select distinct dom from o)
  union all select o.dom, o.n, o.seq, list_filter(o.wish, lambda w: not list_contains(g.used, w))[1], list_append(g.used, list_filter(o.wish, lambda w: not list_contains(g.used, w))[1]) from g join o on o.dom = g.dom and o.n = g.n + 1)
select dom as domain, seq, email from g where email is not null""")
def greedy_match(t: Tables) -> DataFrame:
    """Addresses of a domain to its people, one each; in SQL, people take turns."""
    people = _people(t)
    shown = people.where("seq % 3 <> 0").select("domain", F.concat(F.left("first", F.lit(1)), "last", F.lit("@"), "domain").alias("email")).distinct()
    named = people.select("domain", "first", "last").distinct().withColumn("seq", F.lit(0))
    pairs = matching.name_pairs(named, shown).withColumn("score", t_.email_name_score(F.col("email"), F.col("first"), F.col("last")))
    return matching.greedy_match(people, pairs, alike=["first", "last"])


@query("""with p as (select p_partkey as seq, split_part(p_name, ' ', 1) as f, split_part(p_name, ' ', 2) as l, lower(replace(p_brand, '#', '')) || '.test' as domain from part),
s as (select distinct domain, f[1] || l as x from p where seq % 3 <> 0),
j as (select p.domain, seq, x || '@' || p.domain as email, case when f = '' or l = '' then 0 when x = f || '.' || l then 1 when x = f then 0.8 when x = f || l then 0.9 when x in (f[1] || l, f[1] || '.' || l) then 0.85
when x = l then 0.6 when x = f || '_' || l then 0.9 when x = l || '.' || f then 0.8 when contains(x, f) and contains(x, l) then 0.7 when contains(x, f) then 0.4 when contains(x, l) then 0.5 else 0 end::double as score from p join s on p.domain = s.domain)
select domain, seq, email, score from (select *, row_number() over (partition by seq order by score desc, email) as n from j where score >= 0.3) where n = 1""")
def best_match(t: Tables) -> DataFrame:
    """J8, relaxed: the best address of each person, as a join and a rank."""
    people = _people(t)
    shown = people.where("seq % 3 <> 0").select("domain", F.concat(F.left("first", F.lit(1)), "last", F.lit("@"), "domain").alias("email")).distinct()
    pairs = matching.name_pairs(people, shown).withColumn("score", t_.email_name_score(F.col("email"), F.col("first"), F.col("last")))
    return matching.best_match(pairs.select("domain", "seq", "email", "score"))


@query("select c_custkey, n_name, min_by(s_name, (case when s_acctbal > 5000 then 0 else 1 end) * 100000000 + s_suppkey) as email from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = c_nationkey group by all")
def preferred_contact(t: Tables) -> DataFrame:
    """A ranked pick, made once a nation, since it is the same for all its customers; a supplier without key or name is none."""
    rank = F.when(F.col("s_acctbal") > 5000, 0).otherwise(1) * F.lit(100_000_000).cast("long") + F.col("s_suppkey")
    picks = t.supplier.groupBy("s_nationkey").agg(F.min(F.when(rank.isNotNull() & F.col("s_name").isNotNull(), F.struct(rank.alias("rank"), "s_name"))).alias("pick"))
    nations = t.nation.join(picks, F.col("n_nationkey") == F.col("s_nationkey")).select("n_nationkey", "n_name", "pick")
    rows = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_custkey", "n_name").agg(F.min("pick")["s_name"].alias("email"))


@query("select p_partkey, case when regexp_matches(p_name, '\\d') or len(string_split(p_name, ' ')) < 2 then false else true end as person, p_size * 1000000 as amount from part")
def person_check_amounts(t: Tables) -> DataFrame:
    """Person names, and the amount written as a size in millions."""
    return t.part.select("p_partkey", t_.is_person_name(F.col("p_name")).alias("person"), F.array_max(t_.check_amounts_compat(F.concat(F.lit("$"), "p_size", F.lit("M")))).alias("amount"))


@query("""with n as (select p_partkey, lower(trim(p_name)) as v from part), w as (select p_partkey, replace(v, ' ', '') as c, replace(v, ' ', '-') as h from n where length(replace(v, ' ', '')) >= 4)
select p_partkey, pos::bigint as pos, list_distinct_domain as domain from (select p_partkey, unnest(range(len(l))) as pos, unnest(l) as list_distinct_domain from (select p_partkey, case when c = h then list_transform(['.com', '.vc', '.co', '.capital', '.ventures', '.fund', '.io'], lambda e: c || e) else list_concat(list_transform(['.com', '.vc', '.co', '.capital', '.ventures', '.fund', '.io'], lambda e: c || e), list_transform(['.com', '.vc', '.co', '.capital', '.ventures', '.fund', '.io'], lambda e: h || e)) end as l from w))""")
def domain_candidates(t: Tables) -> DataFrame:
    """P13, G4."""
    return t.part.select("p_partkey", F.posexplode(t_.domain_candidates(F.concat("p_name", F.lit(", LLC")))).alias("pos", "domain"))
