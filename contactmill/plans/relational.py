"""Filters, paging, statistics and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.operators import analytics as a
from contactmill.operators import dedupe, enrich, matching, patterns, state
from contactmill.sources import readers

from .base import Tables, query

AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-30"


def _contacts(t: Tables) -> DataFrame:
    """Customers as contacts: balance as score on a scale of 100, tier by it, address where it is positive."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("c_acctbal") / 100))
    tier = F.when(score >= 80, "HOT").when(score >= 60, "WARM").when(score >= 40, "COOL").otherwise("COLD")
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal", score.alias("score"), tier.alias("tier"), F.when(F.col("c_acctbal") > 0, F.concat("c_name", F.lit("@x.test"))).alias("email"), (F.col("c_acctbal") > 5000).alias("email_verified"))


_CONTACTS = """contacts as (select *, case when score >= 80 then 'HOT' when score >= 60 then 'WARM' when score >= 40 then 'COOL' else 'COLD' end as tier,
  case when c_acctbal > 0 then c_name || '@x.test' end as email, c_acctbal > 5000 as email_verified
  from (select *, greatest(0.0::double, least(100.0::double, c_acctbal / 100)) as score from customer))"""


@query("select c_custkey, c_name, n_name, c_acctbal from customer join nation on c_nationkey = n_nationkey where c_mktsegment ilike '%auto%' and (c_name ilike '%00%' or n_name ilike '%00%') and c_acctbal >= 1000 order by c_acctbal desc, c_custkey limit 50 offset 20")
def lead_filter_page(t: Tables) -> DataFrame:
    """A page of filtered rows."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = a.lead_filter(rows, min_score=1000, score="c_acctbal", search="00", search_in=("c_name", "n_name"), c_mktsegment="auto")
    return a.page(rows, [F.desc("c_acctbal"), "c_custkey"], 20, 50).select("c_custkey", "c_name", "n_name", "c_acctbal")


@query(f"with {_CONTACTS} select c_mktsegment, count(*) as total, count(email) as with_email, count(*) filter (where email_verified) as verified, count(*) filter (where tier = 'HOT') as hot, count(*) filter (where tier = 'WARM') as warm, round(avg(score), 1) as avg_score, count(*) filter (where tier not in ('HOT', 'WARM')) as cool, round(count(email) * 100.0::double / count(*), 1) as email_rate from contacts group by c_mktsegment")
def lead_stats(t: Tables) -> DataFrame:
    """A1, A18."""
    return a.lead_stats(_contacts(t), ["c_mktsegment"])


@query("select n_name, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name order by n desc, n_name limit 10")
def top_funds(t: Tables) -> DataFrame:
    """A2, O8."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return a.top_groups(rows, "n_name")


@query(f"""with o as (select o_orderdate, case when o_orderstatus = 'F' then o_orderdate end as v from orders)
select count(*) as total, count(*) filter (where v >= timestamp '{AS_OF}' - interval 7 days) as verified_7d, count(*) filter (where v >= timestamp '{AS_OF}' - interval 14 days) as verified_14d, count(*) filter (where v is null) as never_verified,
count(*) filter (where o_orderdate >= timestamp '{AS_OF}' - interval 7 days) as crawled_7d, count(*) filter (where o_orderdate < timestamp '{AS_OF}' - interval 7 days) as stale, round(count(*) filter (where o_orderdate >= timestamp '{AS_OF}' - interval 7 days) * 100.0::double / count(*), 1) as fresh_pct from o""")
def freshness_stats(t: Tables) -> DataFrame:
    """A3, R8."""
    return a.freshness(t.orders.withColumn("v", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))), AS_OF, "v", "o_orderdate")


@query("select count(*) as total, count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus = 'P') as failed, round(sum(o_totalprice), 2) as amount, round(count(*) filter (where o_orderstatus = 'F') * 100.0::double / count(*) filter (where o_orderstatus in ('F', 'P')), 1) as success_rate from orders")
def pipeline_stats(t: Tables) -> DataFrame:
    """A4."""
    return a.status_stats(t.orders, "o_orderstatus", "F", "P", "o_totalprice")


@query("select l_returnflag, l_linestatus, count(*) as n, round(count(*)::double / sum(count(*)) over (), 3) as share from lineitem group by all")
def pattern_source_stats(t: Tables) -> DataFrame:
    """A5, A21, A22, A26."""
    return a.breakdown(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("""with x as (select l_suppkey, l_returnflag || l_linestatus as flags, l_orderkey * 10 + l_linenumber as k from lineitem), c as (select l_suppkey, flags, count(*) as n, min(k) as first from x group by all),
g as (select l_suppkey, arg_max(flags, (n, -first)) as flags, max(n) as best, sum(n)::bigint as n, min(first) as first from c group by l_suppkey)
select * from (select 'group' as level, l_suppkey, flags as status, n, null::bigint as groups, round(best / n::double, 3) as share from g order by n desc, first limit 50)
union all select 'value', null, flags, count(*), null, round(count(*) / sum(count(*)) over ()::double, 3) from x group by flags
union all select 'total', null, null, count(*), count(distinct l_suppkey), 1.0::double from x""")
def status_levels(t: Tables) -> DataFrame:
    """Statuses in all, their shares, and the fifty suppliers of most lines with their commonest status."""
    rows = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return patterns.levels(rows, "l_suppkey", "status", "k")


@query(f"select count(*) as total, count(*) filter (where event_type <> 'error') as ok, count(*) filter (where event_type = 'error') as failed, round(avg(v), 2) as avg_duration from (select *, case when event_type <> 'view' then value end as v from events) where ts > timestamp '{EVENTS_AS_OF}' - interval 7 days and ts <= timestamp '{EVENTS_AS_OF}'")
def crawl_health(t: Tables) -> DataFrame:
    """A6."""
    rows = t.events.withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return a.crawl_health(rows, EVENTS_AS_OF, 7, "ts", F.col("event_type") != "error", "v")


@query("""select event_type, count(*) as runs, round(avg(value), 4) as avg_duration, max(value) as max_duration, count(*) filter (where k >= 50) as succeeded, count(*) filter (where k < 50) as failed, round(count(*) filter (where k >= 50)::double / count(*), 4) as success_rate
from (select *, (props->>'$.k')::bigint as k from events) group by event_type""")
def stage_averages(t: Tables) -> DataFrame:
    """A7 to A9."""
    k = F.get_json_object("props", "$.k").cast("long")
    return a.stage_averages(t.events, "event_type", "value", k >= 50)


@query("""select host, count(*) as requests, count(*) filter (where n > 1500) as ok, count(*) filter (where n <= 1500) as blocked, round(avg(n), 4) as avg_seconds, round(count(*) filter (where n > 1500)::double / count(*), 3) as success_rate, round(count(*) filter (where n <= 1500)::double / count(*), 3) as block_rate, count(*) filter (where n <= 1500) * 2 > count(*) as is_blocked
from (select nullif(regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)', 1)), '^www\\.', ''), '') as host, length(html) as n from pages) group by host""")
def scrape_metrics_top_domains(t: Tables) -> DataFrame:
    """A11, A19."""
    from contactmill.functions.text import host

    rows = t.pages.select(host(F.col("url")).alias("host"), F.length("html").alias("n"))
    return a.scrape_metrics(rows, "host", F.col("n") > 1500, F.col("n") <= 1500, "n")


@query(f"with {_CONTACTS} select least(4, floor(score / 20))::bigint as bucket, count(*) as n from contacts group by 1")
def score_histogram(t: Tables) -> DataFrame:
    """A24."""
    return a.histogram(_contacts(t), "score")


@query("""select key, name, source_rank, balance from (select *, row_number() over (partition by key order by source_rank, name) as rn from (
select c_nationkey::bigint as key, c_name as name, 0::bigint as source_rank, c_acctbal as balance from customer union all select s_nationkey::bigint, s_name, 1::bigint, s_acctbal from supplier)) where rn = 1""")
def union_priority_dedupe(t: Tables) -> DataFrame:
    """U1, W1."""
    c = t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return dedupe.union_priority([c, s], ["key"], "name").select("key", "name", "source_rank", "balance")


@query("""select name, fund, array_to_string(list_filter(list_transform(case when contains(focus, '|') then string_split(focus, '|') else string_split_regex(focus, '\\s+') end, lambda x: trim(x)), lambda x: x <> ''), ';') as areas, location, source
from (select c_name as name, c_name as fund, c_mktsegment || '|' || c_nationkey as focus, c_nationkey::varchar as location, 'seed:customer' as source from customer union all select s_name, s_name, 'supply  ' || s_nationkey, s_nationkey::varchar, 'seed:supplier' from supplier)""")
def seed_dialect_union(t: Tables) -> DataFrame:
    """Two dialects of one kind of table."""
    c = t.customer.select(F.col("c_name").alias("name"), F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("sectors"), F.col("c_nationkey").cast("string").alias("hq"))
    s = t.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("supply  "), F.col("s_nationkey")).alias("focus_areas"), F.col("s_nationkey").cast("string").alias("location"))
    out = readers.seed_union([("customer", c), ("supplier", s)], {"customer": "sectors"}, {"customer": "hq"})
    return out.select("name", "fund", F.array_join("focus_areas", ";").alias("areas"), "location", "source")


@query(f"select count(*) as users, count(*) filter (where last < timestamp '{EVENTS_AS_OF}' - interval 2 days) as stale, count(*) filter (where last >= timestamp '{EVENTS_AS_OF}' - interval 2 days) as fresh from (select user_id, max(ts) as last from events group by user_id)")
def stale_fresh_split(t: Tables) -> DataFrame:
    """U4, A20."""
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    stale = state.is_stale(F.col("last"), EVENTS_AS_OF, 2)
    return last.agg(F.count(F.lit(1)).alias("users"), F.count_if(stale).alias("stale"), F.count_if(~stale).alias("fresh"))


@query("select user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type), ['vip', 'click']))), ',') as tags from events group by user_id")
def tag_union(t: Tables) -> DataFrame:
    """U6, D1."""
    tags = t.events.groupBy("user_id").agg(F.array_join(F.collect_set("event_type"), ", ").alias("tags"))
    return tags.select("user_id", state.add_tags(F.col("tags"), F.lit("vip, click")).alias("tags"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '2000-06-01')")
def delta_anti_join(t: Tables) -> DataFrame:
    """J12 to J14, U3."""
    recent = t.orders.where("o_orderdate >= timestamp_ntz '2000-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    return dedupe.only_new(t.customer, recent, ["c_custkey"], "c_name").select("c_custkey", "c_name")


@query("""select o_orderkey, coalesce(case when o_custkey % 5 <> 0 then c_mktsegment end, 'none') as segment, coalesce(case when o_orderpriority <> '5-LOW' then o_orderpriority end, n_name) as label
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def fund_meta_join(t: Tables) -> DataFrame:
    """J1, J3, J10."""
    facts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"), F.col("n_name").alias("label"))
    rows = t.orders.select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("segment"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("label"))
    out = enrich.fill_from(rows, facts, ["o_custkey"], ["segment", "label"])
    return out.select("o_orderkey", F.coalesce("segment", F.lit("none")).alias("segment"), "label")


@query("""select p_partkey, case when a.k is not null then a.k when b.k is not null then b.k else c.k end as size from part
left join (select p_partkey as k0, p_size * 10 as k from part where p_partkey % 3 = 0) a on p_partkey = a.k0 left join (select p_name as k1, max(p_size) as k from part where p_brand = 'Brand#2' group by 1) b on p_name = b.k1 left join (select null as k) c on true""")
def fallback_key_join(t: Tables) -> DataFrame:
    """The short key's facts, else the long key's."""
    facts = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("key"), (F.col("p_size") * 10).alias("size"))
    named = t.part.where("p_brand = 'Brand#2'").groupBy(F.col("p_name").alias("key")).agg(F.max("p_size").alias("size"))
    rows = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("short"), F.col("p_name").alias("full"))
    return enrich.fill_by_either(rows, facts.union(named), "short", "full", "key", ["size"]).select("p_partkey", "size")


@query("""select o_orderkey, case when a.s is not null then 0 when b.s is not null then 1 when c.s is not null then 2 end::bigint as answered_by, coalesce(a.s, b.s, c.s) as status, case when a.s is not null then a.q when b.s is not null then b.q else c.q end as amount
from orders left join (select l_orderkey as k, max(l_returnflag) as s, max(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1) a on o_orderkey = a.k
left join (select l_orderkey as k, max(l_linestatus) as s, max(l_quantity) as q from lineitem where l_linestatus = 'O' group by 1) b on o_orderkey = b.k
left join (select o_orderkey as k, o_orderstatus as s, o_totalprice as q from orders where o_orderstatus <> 'F') c on o_orderkey = c.k""")
def provider_waterfall(t: Tables) -> DataFrame:
    """J6, J7, C3."""
    best = lambda df, s: df.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(s).alias("status"), F.max("l_quantity").alias("amount"))
    sources = [best(t.lineitem.where("l_returnflag = 'R'"), "l_returnflag"), best(t.lineitem.where("l_linestatus = 'O'"), "l_linestatus"), t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))]
    return enrich.waterfall(t.orders.select("o_orderkey"), sources, ["o_orderkey"], ["status", "amount"])


@query("select n_name, count(*) as members, array_to_string(list_sort(list(distinct c_mktsegment)), '; ') as c_mktsegment_set, round(avg(case when c_acctbal > 0 then 1.0::double else 0.0::double end), 4) as email_coverage from customer join nation on c_nationkey = n_nationkey group by n_name")
def fund_aggregate(t: Tables) -> DataFrame:
    """A12."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return a.group_profile(rows, "n_name", ["c_mktsegment"], F.col("c_acctbal") > 0)


@query("select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE'))")
def semi_join_owner(t: Tables) -> DataFrame:
    """J15, J16."""
    nations = t.nation.join(t.region.where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    return t.customer.join(nations, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("select o_orderkey, o_custkey, floor((row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1) / 3)::bigint as batch from orders where o_totalprice >= 100000")
def upload_batches(t: Tables) -> DataFrame:
    """G5."""
    return a.chunks(t.orders.where("o_totalprice >= 100000"), ["o_orderdate", "o_orderkey"], 3, ["o_custkey"]).select("o_orderkey", "o_custkey", "batch")


@query(f"with {_CONTACTS} select c_custkey, email, tier from contacts where score >= 50 and tier in ('HOT', 'WARM') and email is not null and c_custkey % 11 <> 0")
def outreach_eligible(t: Tables) -> DataFrame:
    """P35, P33."""
    return a.eligible(_contacts(t).withColumn("opted_out", F.col("c_custkey") % 11 == 0), 50, ["HOT", "WARM"]).select("c_custkey", "email", "tier")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn <= 7")
def last_points(t: Tables) -> DataFrame:
    """W9, O4."""
    return a.last_n(t.events, "user_id", "event_id", 7).select("user_id", "event_id", "event_type")


@query("""with p as (select c_custkey as seq, c_nationkey as d, row_number() over (partition by c_nationkey order by c_custkey) as n from customer), e as (select s_nationkey as d, s_name as email, row_number() over (partition by s_nationkey order by s_suppkey, s_name) as n from supplier)
select seq, p.d::bigint as domain, email from p left join e on p.d = e.d and p.n = e.n""")
def leftover_assignment(t: Tables) -> DataFrame:
    """J9."""
    return matching.leftovers(t.customer.select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("domain")), t.supplier.select(F.col("s_nationkey").alias("domain"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("email"))).select("seq", "domain", "email")


@query("select y::bigint as year, q::bigint as quarter from range(1999, 2002) a(y), range(1, 5) b(q) where make_date(y, 3 * q - 2, 1) <= date '2001-08-01'")
def quarter_grid(t: Tables) -> DataFrame:
    """G6."""
    return t.spark.sql(readers.quarters(1999, 2001, AS_OF))


@query("select fund, min_by(company, seq) as via, min_by(domain, seq) as domain from (select l_suppkey % 40 as fund, l_partkey as company, 'd' || l_suppkey % 40 as domain, l_orderkey * 10 + l_linenumber as seq from lineitem where l_partkey in (select p_partkey from part where p_brand = 'Brand#2')) where domain not in (select 'd' || s_suppkey from supplier where s_suppkey < 10) group by fund")
def snowball_join(t: Tables) -> DataFrame:
    """J21."""
    named = t.lineitem.select((F.col("l_suppkey") % 40).alias("fund"), F.col("l_partkey").alias("company"), F.concat(F.lit("d"), F.col("l_suppkey") % 40).alias("domain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    seen = t.part.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("company"))
    return enrich.snowball(seen, named, t.supplier.where("s_suppkey < 10").select(F.concat(F.lit("d"), "s_suppkey").alias("domain")))


@query("select company, fund from (select distinct l_partkey as company, l_suppkey as fund from lineitem) order by md5('42|' || company || '|' || fund), company, fund limit 500")
def snowball_sample(t: Tables) -> DataFrame:
    """Five hundred of the stored pairs of company and fund, the same ones each time."""
    return enrich.sample_pairs(t.lineitem.select(F.col("l_partkey").alias("company"), F.col("l_suppkey").alias("fund")), 500)


@query("select vertical, count(*) as n from (select case when c_mktsegment in ('AUTOMOBILE', 'MACHINERY') then 'industry' else 'home' end as vertical from customer where trim(c_name) <> '') group by 1")
def vertical_counts(t: Tables) -> DataFrame:
    """A23."""
    return t.customer.where("trim(c_name) <> ''").groupBy(F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), "industry").otherwise("home").alias("vertical")).agg(F.count(F.lit(1)).alias("n"))
