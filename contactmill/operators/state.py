"""Crawl state, re-crawl order, updates and runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import first_wins


def is_stale(last: Column, as_of: str, days: int = 7) -> Column:
    """Never crawled, or longer ago than the time to live."""
    return F.coalesce(last < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"), F.lit(True))


def latest(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The latest state of each key."""
    return first_wins(events, [key], *order)


def recrawl_order(urls: DataFrame, state: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Stale rows with tier (0 failed, 1 new, 2 five leads or more, 3 rest), yield and staleness, in order."""
    j = urls.join(state, "domain", "left").where(is_stale(F.col("last_crawled_at"), as_of, days))
    seconds = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_crawled_at").cast("timestamp"))) / 1e6
    new = F.col("status").isNull()
    tier = F.when(new, 1).when(F.col("status").isin("error", "timeout", "failed"), 0).when(F.col("leads_found") >= 5, 2).otherwise(3)
    out = j.select(*urls.columns, tier.alias("priority"), F.when(new, 0).otherwise(F.coalesce("leads_found", F.lit(0))).cast("long").alias("leads"), F.when(new, 0.0).otherwise(seconds).alias("staleness"))
    return out.orderBy("priority", F.desc("leads"), F.asc_nulls_last("staleness"), "domain")


def changed(pages: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Whether a page's hash differs from its last one; the first sight counts as changed."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(order))
    return pages.withColumn("changed", ~F.coalesce(F.col(digest) == before, F.lit(False)))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures of each key: number, length, first and last."""
    w = Window.partitionBy(key).orderBy(*order)
    e = events.withColumn("_f", failed).withColumn("_run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.where("_f").groupBy(key, "_run").agg(F.count(F.lit(1)).alias("failures"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")).withColumnRenamed("_run", "run")


def backoff(trips: Column, base: int = 90, cap: int = 600) -> Column:
    """Seconds that a circuit stays open after its n-th trip."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2), trips)).cast("long")


def add_tags(tags: Column, more: Column) -> Column:
    """Sorted union of two comma-joined tag lists."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_union(parts(tags), parts(more))), ",")


def mark(df: DataFrame, ids: DataFrame, on: str, **values: Column) -> DataFrame:
    """New values for the rows whose key is in `ids`."""
    hit = df.join(ids.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return hit.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns], *[F.when(F.col("_hit"), v).alias(c) for c, v in values.items() if c not in df.columns])


def needs_check(df: DataFrame, at: str, as_of: str, days: int = 14) -> DataFrame:
    """Never verified, or too long ago."""
    return df.where(is_stale(F.col(at), as_of, days))


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents."""
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")


def once(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Each event once, the first."""
    return first_wins(events, [key], *order)
