"""Scores, cascades and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.operators import enrich, ml, scoring

from .base import Tables, query

PROFILE = scoring.Profile(as_of="2001-08-01")
_STAGES = ["Seed", "pre-seed", "Series-A", "growth", "N/A", "buyout"]
_ROLES = ["General Partner", "VP", "Analyst", "Office Manager", "N/A"]
_STATUS = ["verified", "scraped", "guessed", "undeliverable", "dorked"]


def _pick(options: list[str], n) -> F.col:
    return F.get(F.array(*map(F.lit, options)), (n % len(options)).cast("int"))


def leads(t: Tables) -> DataFrame:
    """Orders as leads."""
    k = F.col("o_orderkey")
    sectors = F.when(k % 7 == 0, F.expr("cast(array() as array<string>)")).when(k % 7 < 3, F.array(F.lit("AI infrastructure"), F.lit("fintech"))).when(k % 7 < 5, F.array(F.lit("SaaS"), F.lit("ai"))).otherwise(F.array(F.lit("biotech")))
    check = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "N/A").otherwise(F.concat(F.lit("$"), (F.col("o_custkey") % 900 + 1), F.lit("K - $"), (F.col("o_custkey") % 900 + 100), F.lit("K")))
    return t.orders.select(k.alias("seq"), _pick(_STAGES, k).alias("stage"), sectors.alias("sectors"), check.alias("check_size"), F.col("o_orderdate").alias("scraped_at"), _pick(_ROLES, k).alias("role"), F.when(k % 3 != 0, F.concat(F.lit("a"), k, F.lit("@x.test"))).otherwise("N/A").alias("email"), _pick(_STATUS, k).alias("email_status"), F.when(k % 2 == 0, F.concat(F.lit("https://linkedin.com/in/a"), k)).alias("linkedin"), (k % 4).alias("times_seen"))


def _case(n: str, values: list) -> str:
    return f"case {n} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


@query(f"""with o as (select o_orderkey as k, o_custkey as c, (epoch(timestamp '2001-08-01') - epoch(o_orderdate)) / 86400.0::double as d from orders),
s as (select k, {_case("k", [30, 30, 6, 0, 10, 10])} as st, case when k % 7 = 0 then 6 when k % 7 < 3 then 9 when k % 7 < 5 then 18 else 0 end as se, case when k % 7 = 0 then 3 when k % 7 < 3 then 9 when k % 7 < 5 then 15 else 1 end as po,
case when k % 5 < 2 then 6 when (c % 900 + 1) <= 500 and (c % 900 + 100) >= 50 then 20 else 3 end as ch, case when greatest(d, 0) < 1 then 10 else greatest(1, floor(10 * exp(-0.693::double * greatest(d, 0) / 14))) end::bigint as re,
{_case("k", [15, 10, 5, -5, 0])} as ro, {_case("k", [8, 5, 1, -3, 0])} + case when k % 4 >= 3 then 3 when k % 4 >= 2 then 1 else 0 end + case when k % 3 <> 0 and k % 2 = 0 then 2 else 0 end as en,
case when k % 3 <> 0 then 10 else -15 end + case when k % 2 = 0 then 5 else 0 end + case when floor(d) > 60 then -10 else 0 end as ex from o),
x as (select k, greatest(0, least(100, st + se + po + ch + re + ro + en + ex))::bigint as score from s)
select k as seq, score, case when score >= 80 then 'HOT' when score >= 60 then 'WARM' when score >= 40 then 'COOL' else 'COLD' end as tier from x order by score desc, seq""")
def lead_score(t: Tables) -> DataFrame:
    """The flagship: score, tier, best first."""
    c = F.col
    score = scoring.total(PROFILE, c("stage"), c("sectors"), c("check_size"), c("scraped_at"), c("role"), c("email"), c("email_status"), c("linkedin"), c("times_seen"))
    out = leads(t).select("seq", score.alias("score"))
    return out.select("seq", "score", scoring.tier(c("score"), PROFILE).alias("tier")).orderBy(F.desc("score"), "seq")


_EMAIL = "case event_id % 6 when 0 then 'bad' when 1 then 'a@mailinator.com' when 2 then 'info@x.test' else 'u' || user_id || '@x.test' end"


@query(f"""with e as (select event_id, user_id, {_EMAIL} as em, (props->>'$.k')::bigint as k from events), f as (select *, case when k % 4 = 0 then false when k % 4 = 1 then null else true end as mx, k % 10 = 0 as dns, case when k > 80 then true when k > 60 then false end as del, k % 2 = 0 as ca, case when k < 20 then true when k < 30 then false end as ext from e),
g as (select *, em like '%@%' as ok, em like '%@mailinator.com' as dis, em like 'info@%' as rol from f)
select event_id, case when not ok then 'invalid' when dis then 'low' when rol then 'medium' when dns then 'medium' when not coalesce(mx, false) then 'low' else 'high' end as quality,
case when not ok then 'invalid' when dis then 'invalid' when rol then 'risky' when not mx then 'invalid' when del and ca then 'risky' when del then 'valid' when not del then 'invalid' when ext then 'valid' when not ext then 'invalid' when mx then 'risky' else 'unknown' end as verdict,
case when not ok then 1.0 when dis then 0.95 when rol then 0.7 when not mx then 0.9 when del and ca then 0.6 when del then 0.9 when not del then 0.95 when ext then 0.8 when not ext then 0.8 when mx then 0.4 else 0.2 end::double as confidence,
case when del and ca then 'catch_all' when del then 'verified' when not del then 'undeliverable' else 'unknown' end as email_status, case when k = 0 then true when k % 50 in (1, 2) then false end as by_code from g""")
def status_cascade(t: Tables) -> DataFrame:
    """C1, C2, C4, J5."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.col("event_id") % 6
    rows = t.events.select("event_id", k.alias("k"), F.when(m == 0, "bad").when(m == 1, "a@mailinator.com").when(m == 2, "info@x.test").otherwise(F.concat(F.lit("u"), "user_id", F.lit("@x.test"))).alias("email"))
    k = F.col("k")
    rows = rows.withColumns({"mx": F.when(k % 4 == 0, False).when(k % 4 == 1, None).otherwise(True), "dns": k % 10 == 0, "del": F.when(k > 80, True).when(k > 60, False), "ca": k % 2 == 0, "ext": F.when(k < 20, True).when(k < 30, False), "code": F.when(k == 0, 250).when(k % 50 == 1, 550).when(k % 50 == 2, 553).otherwise(-1)})
    c = F.col
    rows = rows.withColumn("q", enrich.email_quality(c("email"), c("mx"), c("dns")))
    v = enrich.verdict(c("q.quality") != "invalid", c("q.disposable"), c("q.role_based"), c("mx"), c("del"), c("ca"), c("ext"), F.lit(None).cast("double"))
    return rows.select("event_id", c("q.quality").alias("quality"), v["verdict"].alias("verdict"), v["confidence"].alias("confidence"), enrich.probe_status(F.lit("unknown"), c("del"), c("ca")).alias("email_status"), enrich.probe_code(c("code")).alias("by_code"))


@query("""with e as (select o_custkey, max(o_orderdate) >= timestamp '2001-01-01' as rc, count(*) filter (where o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '2000-01-01') > 0 as rp, count(*) filter (where o_orderstatus = 'P' and o_orderdate >= timestamp '2001-01-01') > 0 as rn, count(*) as n, count(*) filter (where o_orderstatus = 'F') as l, count(*) filter (where o_orderstatus = 'O') as f from orders group by 1),
g as (select *, round(case when rc then 0.4::double when n > 0 then 0.2::double else 0 end + case when rp then 0.2::double else 0 end + case when rn then 0.3::double else 0 end + case when n >= 5 then 0.1::double else 0 end, 6) as evidence from e)
select o_custkey, evidence, case when evidence >= 0.5 then 'active' when evidence >= 0.2 then 'possibly_active' when evidence > 0 then 'stale' else 'unknown' end as status, case when l = 0 and f = 0 then 'unknown' when l > f then 'lead' when f > l then 'follow' else 'both' end as side from g""")
def active_status(t: Tables) -> DataFrame:
    """C17, C18."""
    at, c = F.col("o_orderdate"), F.col
    recent = lambda y: at >= F.lit(f"{y}-01-01").cast("timestamp_ntz")
    rows = t.orders.groupBy("o_custkey").agg((F.count_if(recent(2001)) > 0).alias("rc"), (F.count_if((c("o_orderpriority") == "1-URGENT") & recent(2000)) > 0).alias("rp"), (F.count_if((c("o_orderstatus") == "P") & recent(2001)) > 0).alias("rn"), F.count(F.lit(1)).alias("n"), F.count_if(c("o_orderstatus") == "F").alias("l"), F.count_if(c("o_orderstatus") == "O").alias("f"))
    s = scoring.active_status(c("rc"), c("n") > 0, c("rp"), c("rn"), c("n"))
    return rows.select("o_custkey", s["evidence"].alias("evidence"), s["status"].alias("status"), scoring.lead_or_follow(c("l"), c("f"), F.lit(0), F.lit(0)).alias("side"))


@query("select event_id, greatest(0, least(100, case when event_type = 'purchase' then 70 else 0 end + case when event_type = 'error' then -40 else 0 end + case when value > 10 then 45 else 0 end))::bigint as score from events")
def outcome_score(t: Tables) -> DataFrame:
    """A28, X9."""
    e = F.col("event_type")
    return t.events.select("event_id", scoring.outcome_score([(e == "purchase", 70), (e == "error", -40), (F.col("value") > 10, 45)]).alias("score"))


@query("select o_orderkey, label, case upper(regexp_extract(label, '([A-Za-z]+)\\s*$', 1)) when 'HOT' then 'HOT' when 'WARM' then 'WARM' else 'COOL' end as tier from (select o_orderkey, case o_orderstatus when 'F' then '🔴 HOT' when 'P' then '🟡 WARM' else '⚪ COLD' end as label from orders)")
def tier_labels(t: Tables) -> DataFrame:
    """T2, T3."""
    s = F.col("o_orderstatus")
    label = scoring.tier_label(F.when(s == "F", "HOT").when(s == "P", "WARM").otherwise("COLD"))
    return t.orders.select("o_orderkey", label.alias("label"), scoring.tier_of_label(label).alias("tier"))


@query()
def ml_quality_score(t: Tables) -> DataFrame:
    """A model of label quality from text statistics."""
    words = F.split(F.trim("text"), r"\s+")
    n = F.size(words)
    feats = t.documents.select("doc_id", F.log1p(n).alias("n_words"), (F.size(F.array_distinct(words)) / n).alias("distinct_part"), (F.regexp_count("text", F.lit(r"[#*$%&|<>]")) / n).alias("symbols"), (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.length("text")).alias("capitals"), (F.col("n_chars") / n).alias("word_length"))
    rows = feats.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    model, _ = ml.train(rows, ["n_words", "distinct_part", "symbols", "capitals", "word_length"], "label", "doc_id")
    return ml.predict(model, feats).select("doc_id", "ml_score", "confidence")


def lead_rows(t: Tables) -> DataFrame:
    """Leads with features and whether their score is a good one."""
    c = F.col
    rows = leads(t).withColumnRenamed("sectors", "focus_areas").withColumn("website", F.when(c("seq") % 4 != 0, "x.test"))
    score = scoring.total(PROFILE, c("stage"), c("focus_areas"), c("check_size"), c("scraped_at"), c("role"), c("email"), c("email_status"), c("linkedin"), c("times_seen"))
    label = rows.select("seq", ml.target(score).cast("double").alias("label"))
    return ml.lead_features(rows, "seq", PROFILE.as_of).join(label, "seq")


@query()
def ml_lead_score(t: Tables) -> DataFrame:
    """A model of good leads, trained on the 17 features and the rule score of 60 or more."""
    rows = lead_rows(t)
    model, _ = ml.train(rows, ml.FEATURES, "label", "seq", rounds=20, trees=20)
    return ml.predict(model, rows).select("seq", "ml_score", "confidence", "label")
