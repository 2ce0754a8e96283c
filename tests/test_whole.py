"""Queries over whole tables: against SQL without the cuts that a twin still has, and on small tables."""

import pytest
from differential import differences, duck
from pyspark.sql import functions as F

from contactmill.plans import catalogue


def whole(name: str, cut: str, instead: str = "") -> str:
    """A query's twin without a cut, whether or not the twin has it."""
    return catalogue.SQL[name].replace(cut, instead)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_recrawl_priority_has_every_user(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").where("user_id % 2 = 0 or ts < timestamp_ntz '2024-01-20'").withColumn("user_id", F.col("user_id") + 195).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["recrawl_priority"](spark, str(tmp_path))
    assert got.where("domain >= 200").count() > 0
    sql = whole("recrawl_priority", "select unnest(range(0, 200)) as domain", "select user_id as domain from events union select unnest(range(0, 200))")
    assert differences(got, duck(str(tmp_path)), sql) == []


def test_best_match_ranks_all_scores(spark, sf, con):
    sql = """with p as (select p_partkey as seq, split_part(p_name, ' ', 1) as f, split_part(p_name, ' ', 2) as l, lower(replace(p_brand, '#', '')) || '.test' as domain from part),
    s as (select distinct domain, f[1] || l as x from p where seq % 3 <> 0),
    j as (select p.domain, seq, x || '@' || p.domain as email, case when f = '' or l = '' then 0 when x = f || '.' || l then 1 when x = f then 0.8 when x = f || l then 0.9 when x in (f[1] || l, f[1] || '.' || l) then 0.85
    when x = l then 0.6 when x = f || '_' || l then 0.9 when x = l || '.' || f then 0.8 when contains(x, f) and contains(x, l) then 0.7 when contains(x, f) then 0.4 when contains(x, l) then 0.5 else 0 end::double as score from p join s on p.domain = s.domain)
    select domain, seq, email, score from (select *, row_number() over (partition by seq order by score desc, email) as n from j where score >= 0.3) where n = 1"""
    got = catalogue.QUERIES["best_match"](spark, sf)
    assert got.where("score <> 0.85").count() > 0
    assert differences(got, con, sql) == []


def test_json_list_parse_reads_every_event(spark, sf, con):
    assert differences(catalogue.QUERIES["json_list_parse"](spark, sf), con, whole("json_list_parse", " where event_id % 3 = 0")) == []


def test_lead_score_returns_every_lead(spark, sf, con):
    got = catalogue.QUERIES["lead_score"](spark, sf)
    assert differences(got, con, whole("lead_score", " limit 1000")) == []
    keys = [(-r["score"], r["seq"]) for r in got.collect()]
    assert keys == sorted(keys)


def test_line_parse_returns_every_line(spark, sf, con):
    assert differences(catalogue.QUERIES["line_parse"](spark, sf), con, whole("line_parse", " where length(line) > 400")) == []
    assert {"table_parse", "bullet_parse"} <= set(catalogue.QUERIES)


def test_union_priority_dedupe_takes_every_customer(spark, sf, con, tmp_path):
    sql = whole("union_priority_dedupe", " where c_nationkey < 20")
    assert differences(catalogue.QUERIES["union_priority_dedupe"](spark, sf), con, sql) == []
    spark.read.parquet(f"{sf}/customer.parquet").where("c_nationkey > 3").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "s", 1.0), (24, "t", 2.0)], "s_nationkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["union_priority_dedupe"](spark, str(tmp_path))
    assert {r["key"]: r["source_rank"] for r in got.where("key in (0, 24)").collect()} == {0: 1, 24: 0}
    assert differences(got, duck(str(tmp_path)), sql) == []


def test_stale_fresh_split_sees_late_events(spark, sf, con, tmp_path):
    sql = whole("stale_fresh_split", " where user_id % 7 <> 0 or ts < timestamp '2024-01-20'")
    assert differences(catalogue.QUERIES["stale_fresh_split"](spark, sf), con, sql) == []
    spark.sql("select * from values (7, timestamp_ntz '2024-01-02'), (7, timestamp_ntz '2024-01-30'), (8, timestamp_ntz '2024-01-02') as e(user_id, ts)").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["stale_fresh_split"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(2, 1, 1)]


def test_preferred_contact_is_picked_once_a_nation(spark, sf, con, tmp_path):
    assert differences(catalogue.QUERIES["preferred_contact"](spark, sf), con, catalogue.SQL["preferred_contact"]) == []
    # Customers twice in a nation and in two, nations of one key and of one name, none, poor and unknown suppliers; the last nation has 4 * 10^8 pairs.
    customers = [(1, 0), (1, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (None, 0), (6, None), (7, 9)]
    nations = [(0, "a"), (0, "b"), (1, "a"), (2, None), (3, "c"), (4, "d"), (5, "e"), (None, "f")]
    suppliers = [(1, "s1", 0, 1.0), (2, "s2", 0, 5000.0), (3, "s3", 0, 5001.0), (4, "s4", 1, None), (5, "s5", 2, 9e9), (None, "s6", 2, 9e9), (0, None, 2, 9e9), (None, "s7", 3, 1.0), (300_000_000, "s8", 1, 6e3), (9, "s9", None, 6e3), (8, "s0", 5, float("nan"))]
    spark.createDataFrame(nations, "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").union(spark.range(1000, 21000).selectExpr("id", "5")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").union(spark.range(1000, 21000).selectExpr("id", "string(id)", "5", "1d")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["preferred_contact"](spark, str(tmp_path))
    assert got.where("c_custkey >= 1000 and email = 's0'").count() == 20000
    few = got.where("c_custkey < 1000 or c_custkey is null")
    folder = duck(str(tmp_path))
    folder.execute("create table few as select * from customer where c_custkey < 1000 or c_custkey is null")
    assert differences(few, folder, catalogue.SQL["preferred_contact"].replace("from customer", "from few as customer")) == [] and few.count() == 7
