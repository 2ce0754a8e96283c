"""Best members and pages of groups, counts over stores, and features of leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.operators import analytics, ml

from .base import Tables, query

AS_OF = "2001-08-01"


@query("""with r as (select c_nationkey, c_custkey, c_acctbal / 100 as score, count(*) filter (where c_acctbal / 100 >= 99) over (partition by c_nationkey) as many, row_number() over (partition by c_nationkey order by c_acctbal / 100 desc, c_custkey) as rank from customer)
select c_nationkey, c_custkey, rank from r where rank <= least(10, case when many > 0 then many else 3 end)""")
def decision_makers(t: Tables) -> DataFrame:
    """Members of a score or more, else the first three, ten at most. The bar is raised to 99, so that both happen."""
    rows = t.customer.select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 100).alias("score"))
    return analytics.decision_makers(rows, "c_nationkey", "score", "c_custkey", least=99).select("c_nationkey", "c_custkey", "rank")


@query("select source, lang, max(n) as richness, arg_max(doc_id, n * 1000000 - doc_id) as doc_id from (select *, contains(text, 'tion')::bigint + contains(text, 'heit')::bigint + contains(text, 'ment')::bigint as n from documents) group by source, lang")
def best_posts(t: Tables) -> DataFrame:
    """Of each group the text with the most keywords, the first in a tie."""
    n = sum((F.contains("text", F.lit(w)).cast("int") for w in ("tion", "heit", "ment")), F.lit(0))
    return analytics.best_of(t.documents.withColumn("richness", n), ["source", "lang"], "richness", "doc_id", "doc_id")


@query("""with k as (select s_suppkey, unnest(['ai', 'bio', 'saas', 'food', 'toys', 'cars', 'zinc']) as w, unnest([s_suppkey % 7, s_suppkey % 5, 3, s_suppkey % 3, 3, 1, 9])::bigint as n, unnest(range(7)) as i from supplier)
select s_suppkey, string_agg(w, ',' order by n desc, i) as sectors from (select *, row_number() over (partition by s_suppkey order by n desc, i) as rn from k) where rn <= 5 group by s_suppkey""")
def top_sectors(t: Tables) -> DataFrame:
    """The five keywords counted most, in order in a tie."""
    n = F.col("s_suppkey")
    counts = F.create_map(*[x for k, v in {"ai": n % 7, "bio": n % 5, "saas": F.lit(3), "food": n % 3, "toys": F.lit(3), "cars": F.lit(1), "zinc": F.lit(9)}.items() for x in (F.lit(k), v.cast("long"))])
    return t.supplier.select("s_suppkey", F.array_join(analytics.top_entries(counts), ",").alias("sectors"))


@query("select count(*) as total_unique_leads, count(*) filter (where n % 2 = 0) as with_email, count(*) filter (where n > 1) as seen_multiple_times from (select o_custkey, count(*) as n from orders group by o_custkey)")
def index_stats(t: Tables) -> DataFrame:
    """A17."""
    index = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("times_seen"))
    return analytics.index_stats(index.withColumn("email", F.when(F.col("times_seen") % 2 == 0, "x")))


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) as n_so_far from events")
def running_totals(t: Tables) -> DataFrame:
    """Events of a user so far."""
    return analytics.running_count(t.events, "user_id", "ts", "event_id").select("event_id", "n_so_far")


@query("select count(*) as domains_cached, count(*) filter (where s_acctbal > 0) as domains_with_mx, count(*) filter (where s_acctbal > 9000) as dns_error_domains from supplier")
def cache_stats(t: Tables) -> DataFrame:
    """A29."""
    return analytics.cache_stats(t.supplier.select("s_name", (F.col("s_acctbal") > 0).alias("has_mx"), F.when(F.col("s_acctbal") > 9000, True).alias("dns_error")))


@query("select l_suppkey, sent, opened, replied, round(opened * 100.0::double / sent, 2) as open_rate, round(replied * 100.0::double / sent, 2) as reply_rate from (select l_suppkey, count(*) as sent, count(*) filter (where l_tax > 0.04) as opened, count(*) filter (where l_returnflag = 'R') as replied from lineitem group by l_suppkey)")
def outreach_rates(t: Tables) -> DataFrame:
    """A30."""
    return analytics.rates(t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("l_tax") > 0.04).alias("opened"), F.count_if(F.col("l_returnflag") == "R").alias("replied")))


@query("select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def newest_page(t: Tables) -> DataFrame:
    """O3: a page of the newest rows."""
    return analytics.page(t.orders, [F.desc("o_orderdate"), "o_orderkey"], 40, 20).select("o_orderkey")


@query("select c_custkey, row_number() over (order by case when c_custkey % 2 = 0 then 0 else 1 end, case when c_custkey % 3 = 0 then 0 else 1 end, c_custkey) as place from customer order by place limit 100")
def vendor_order(t: Tables) -> DataFrame:
    """The first hundred to be asked for: without address first, then without profile."""
    k = F.col("c_custkey")
    order = [*analytics.vendor_order(F.when(k % 2 == 1, "x"), F.when(k % 3 != 0, "x")), k]
    from pyspark.sql import Window

    first = t.customer.orderBy(*order).limit(100)
    return first.select("c_custkey", F.row_number().over(Window.orderBy(*order)).alias("place"))  # a hundred rows


@query("select p_partkey, list_sort(list_intersect(string_split(p_name, ' '), string_split(reverse(p_name), ' ')))::varchar as both from part")
def word_intersect(t: Tables) -> DataFrame:
    """Words that two texts share."""
    both = F.array_sort(F.array_intersect(F.split("p_name", " "), F.split(F.reverse("p_name"), " ")))
    return t.part.select("p_partkey", F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")).alias("both"))


def _leads(t: Tables) -> DataFrame:
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    areas = F.when(m == 0, F.array(F.lit("AI tools"), F.lit("Food"))).when(m == 1, F.array(F.lit("Software"))).when(m == 2, F.array(F.lit("Cars")))
    return t.orders.select(
        k, F.when(m == 0, "Seed").when(m == 1, "series a").when(m == 2, "odd").alias("stage"), areas.alias("focus_areas"), F.when(k % 3 != 0, "a@x.test").alias("email"),
        F.when(k % 3 == 1, "verified").when(k % 3 == 2, "catch_all").alias("email_status"), F.when(m == 1, "https://linkedin.com/in/x").when(m == 2, "x").alias("linkedin"),
        F.when(m == 0, "General Partner").when(m == 1, "VP Sales").when(m == 2, "Cook").alias("role"), F.when(m == 0, "$25K - $1M").when(m == 1, "none").alias("check_size"), (k % 5).alias("times_seen"),
        F.col("o_orderdate").alias("scraped_at"), F.when(m != 3, "x.test").alias("website"), "o_totalprice",
    )


@query(f"""with o as (select *, o_orderkey as k, o_orderkey % 4 as m from orders)
select o_orderkey, case m when 0 then 1 when 1 then 2 else -1 end::double as stage_encoded, case m when 0 then 2 when 1 then 1 when 2 then 1 else 0 end::double as sector_count, (m = 0)::int::double as sector_ai, (m = 1)::int::double as sector_saas, 0::double as sector_fintech, 0::double as sector_health, (m = 2)::int::double as sector_other,
(k % 3 <> 0)::int::double as has_email, (k % 3 = 1)::int::double as email_verified, (k % 3 = 2)::int::double as email_catch_all, (m = 1)::int::double as has_linkedin, case m when 0 then 4 when 1 then 3 else -1 end::double as role_encoded,
case when m = 0 then 0.0025 else -1 end::double as check_size_min_normalized, case when m = 0 then 0.1 else -1 end::double as check_size_max_normalized, (k % 5)::double as times_seen, floor((epoch(timestamp '{AS_OF}') - floor(epoch(o_orderdate))) / 86400)::double as days_since_scraped, (m <> 3)::int::double as has_website from o""")
def lead_features(t: Tables) -> DataFrame:
    """The 17 features of leads."""
    return ml.lead_features(_leads(t), "o_orderkey", AS_OF)


@query("select o_orderkey, (o_totalprice / 5000 >= 60)::bigint as target from orders")
def training_target(t: Tables) -> DataFrame:
    """The training label of a stored score."""
    return t.orders.select("o_orderkey", ml.target(F.col("o_totalprice") / 5000).alias("target"))
