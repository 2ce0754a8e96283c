"""Filters, paging, counts and rates over contacts, runs, crawls and ledgers. One pass and one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 1, scale: float = 100.0) -> Column:
    """part / whole, scaled and rounded; 0 where whole is 0."""
    return F.coalesce(F.round(F.try_divide(part * scale, whole), digits), F.lit(0.0))


def contains(column: str | Column, text: str | None) -> Column:
    """Case-blind containment; % and _ in the text are wildcards, as they always were."""
    return F.lit(True) if text is None else F.coalesce((F.col(column) if isinstance(column, str) else column).ilike(f"%{text}%"), F.lit(False))


def lead_filter(df: DataFrame, *, tier: str | None = None, min_score: float | None = None, has_email: bool | None = None, email_status: str | None = None, search: str | None = None, search_in: tuple[str, ...] = (), score: str = "score", **parts: str) -> DataFrame:
    """Any of the optional predicates; `parts` are containments by column."""
    if tier is not None:
        df = df.where(F.col("tier") == tier)
    if min_score is not None:
        df = df.where(F.col(score) >= min_score)
    if has_email is not None:
        df = df.where(F.col("email").isNotNull() if has_email else F.col("email").isNull())
    if email_status is not None:
        df = df.where(F.col("email_status") == email_status)
    for c, text in parts.items():
        df = df.where(contains(c, text))
    if search is not None:
        hit = F.lit(False)
        for c in search_in:
            hit = hit | contains(c, search)
        df = df.where(hit)
    return df


def page(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 50) -> DataFrame:
    """O2, O3: one page; a top-k plan, not a full sort. The order must be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def lead_stats(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """A1: totals, address rate, tiers (COOL is the rest, T17) and mean score."""
    n = F.count(F.lit(1))
    out = df.groupBy(*by).agg(n.alias("total"), F.count_if(F.col("email").isNotNull()).alias("with_email"), F.count_if("email_verified").alias("verified"), F.count_if(F.col("tier") == "HOT").alias("hot"), F.count_if(F.col("tier") == "WARM").alias("warm"), F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("avg_score"))
    return out.select("*", (F.col("total") - F.col("hot") - F.col("warm")).alias("cool"), share(F.col("with_email"), F.col("total")).alias("email_rate"))


def top_groups(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Groups of most rows, by name in a tie."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def freshness(df: DataFrame, as_of: str, verified: str, crawled: str) -> DataFrame:
    """A3: verified within 7 and 14 days or never, crawled within 7, and the rest."""
    within = lambda c, d: F.count_if(F.col(c) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {d} days"))
    out = df.agg(F.count(F.lit(1)).alias("total"), within(verified, 7).alias("verified_7d"), within(verified, 14).alias("verified_14d"), F.count_if(F.col(verified).isNull()).alias("never_verified"), within(crawled, 7).alias("crawled_7d"))
    return out.select("*", (F.col("total") - F.col("crawled_7d")).alias("stale"), share(F.col("crawled_7d"), F.col("total")).alias("fresh_pct"))


def status_stats(df: DataFrame, status: str, done: str, failed: str, amount: str) -> DataFrame:
    """Counts by status, sum, and the rate of success among what ended."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == done).alias("completed"), F.count_if(F.col(status) == failed).alias("failed"), F.round(F.sum(amount), 2).alias("amount"))
    return out.select("*", share(F.col("completed"), F.col("completed") + F.col("failed")).alias("success_rate"))


def breakdown(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group and their share of all."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select("*", share(F.col("n"), F.sum("n").over(Window.partitionBy()), 3, 1.0).alias("share"))  # one row a group


def crawl_health(df: DataFrame, as_of: str, days: int, at: str, ok: Column, duration: str) -> DataFrame:
    """Crawls of the last days, how many went well, mean duration of those that have one."""
    recent = df.where((F.col(at) > F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")) & (F.col(at) <= F.lit(as_of).cast("timestamp")))
    return recent.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg(duration), 2).alias("avg_duration"))


def stage_averages(df: DataFrame, stage: str, duration: str, ok: Column) -> DataFrame:
    """Each stage's mean duration, outcomes and rate of success; null without outcome."""
    out = df.groupBy(stage).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(duration), 4).alias("avg_duration"), F.max(duration).alias("max_duration"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return out.select("*", F.round(F.try_divide("succeeded", F.col("succeeded") + F.col("failed")), 4).alias("success_rate"))


def scrape_metrics(df: DataFrame, domain: str, ok: Column, blocked: Column, seconds: str) -> DataFrame:
    """Each domain's requests, rates and mean time, and whether it blocks more than half."""
    out = df.groupBy(domain).agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("ok"), F.count_if(blocked).alias("blocked"), F.round(F.avg(seconds), 4).alias("avg_seconds"))
    return out.select("*", share(F.col("ok"), F.col("requests"), 3, 1.0).alias("success_rate"), share(F.col("blocked"), F.col("requests"), 3, 1.0).alias("block_rate"), (F.col("blocked") * 2 > F.col("requests")).alias("is_blocked"))


def group_profile(df: DataFrame, by: str, sets: list[str], email: Column) -> DataFrame:
    """Size, distinct values (sorted, joined) and address coverage of each group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("members"), *[F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(f"{c}_set") for c in sets], F.round(F.avg(F.when(email, 1.0).otherwise(0.0)), 4).alias("email_coverage"))


def histogram(df: DataFrame, score: str, edges: tuple[float, ...] = (0, 20, 40, 60, 80, 100)) -> DataFrame:
    """Rows in each bucket, the last closed above; other scores are left out."""
    s, bucket = F.col(score), None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        last = i == len(edges) - 2
        bucket = (F if bucket is None else bucket).when((s >= a) & ((s <= b) if last else (s < b)), i)
    return df.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def running_balance(ledger: DataFrame, user: str, amount: str, *order: str) -> DataFrame:
    """Balance after each entry of a user."""
    return ledger.withColumn("balance_after", F.sum(amount).over(Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def spend(used: Column, left: Column) -> Column:
    """Never more than is left; `prefix.ledger` keeps what is left."""
    return F.least(used, left)


def chunks(df: DataFrame, order: list[str], size: int, parts: list[str]) -> DataFrame:
    """Number of the batch of `size` rows, counted within `parts`; `prefix.chunks` counts over the whole table."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1) / size))


def eligible(df: DataFrame, min_score: float, tiers: list[str]) -> DataFrame:
    """Who may be written to."""
    return df.where((F.col("score") >= min_score) & F.col("tier").isin(tiers) & F.col("email").isNotNull() & ~F.col("opted_out"))


def rates(df: DataFrame) -> DataFrame:
    """Open and reply rates."""
    return df.select("*", share(F.col("opened"), F.col("sent"), 2).alias("open_rate"), share(F.col("replied"), F.col("sent"), 2).alias("reply_rate"))


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n points of each series."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def run_totals(df: DataFrame) -> DataFrame:
    """A10: each run's greatest lead count and its errors."""
    return df.groupBy("run_id").agg(F.max("lead_count").alias("lead_count"), F.sum("error_count").alias("error_count"))


def index_stats(index: DataFrame) -> DataFrame:
    """Unique leads of an index, those with an address, and those seen more than once."""
    return index.agg(F.count(F.lit(1)).alias("total_unique_leads"), F.count_if(F.col("email").isNotNull()).alias("with_email"), F.count_if(F.coalesce("times_seen", F.lit(1)) > 1).alias("seen_multiple_times"))


def running_count(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Number of rows of a series so far."""
    return df.withColumn("n_so_far", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def cache_stats(cache: DataFrame) -> DataFrame:
    """Cached domains, those that take mail, and those whose lookup failed. `cache`: (domain, has_mx, dns_error)."""
    return cache.agg(F.count(F.lit(1)).alias("domains_cached"), F.count_if(F.coalesce("has_mx", F.lit(False))).alias("domains_with_mx"), F.count_if(F.coalesce("dns_error", F.lit(False))).alias("dns_error_domains"))


def decision_makers(df: DataFrame, by: str, score: str, order: str, least: float = 60, fallback: int = 3, most: int = 10) -> DataFrame:
    """A group's members of `least` or more, its first three by score if there are none; ten at most, earlier first in a tie."""
    w = Window.partitionBy(by)
    many = F.count_if(F.col(score) >= least).over(w)
    rank = F.row_number().over(w.orderBy(F.desc(score), order))
    return df.withColumn("_n", F.least(F.lit(most), F.when(many > 0, many).otherwise(fallback))).withColumn("rank", rank).where(F.col("rank") <= F.col("_n")).drop("_n")


def best_of(df: DataFrame, by: list[str], score: str, order: str, *take: str) -> DataFrame:
    """Of each group the row of greatest score, the first in a tie."""
    return df.groupBy(*by).agg(F.max_by(F.struct(score, *take), F.struct(F.col(score), -F.col(order))).alias("_b")).select(*by, "_b.*")


def top_entries(counts: Column, n: int = 5) -> Column:
    """The n keys of a map with the greatest values, in the map's order in a tie."""
    rows = F.transform(F.map_entries(counts), lambda e, i: F.struct((-e["value"]).alias("v"), i.alias("i"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(rows), 1, n), lambda r: r["k"])


def vendor_order(email: Column, linkedin: Column) -> list[Column]:
    """Without address first, then without profile."""
    return [F.when(email.isNull(), 0).otherwise(1), F.when(linkedin.isNull(), 0).otherwise(1)]
