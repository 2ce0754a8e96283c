"""Identity: first-wins, two-level and folding dedupe, anti-joins, merges. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank of an address's status; labels not listed rank as unknown.
STATUS_RANK = {"verified": 5, "scraped": 4, "catch_all": 3, "guessed": 2, "unknown": 1, "undeliverable": 0}


def status_rank(status: Column) -> Column:
    out = F.when(status == "verified", 5)
    for label, rank in list(STATUS_RANK.items())[1:]:
        out = out.when(status == label, rank)
    return out.otherwise(1)


def first_wins(df: DataFrame, keys: list[str | Column], *order: str | Column) -> DataFrame:
    """The first row of each key by `order`. One shuffle on the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def two_level(df: DataFrame, keys: list[str], email: str, *order: str) -> DataFrame:
    """First by key, then by address among the survivors; rows without address never collide."""
    kept = first_wins(df, keys, *order)
    return first_wins(kept.where(F.col(email).isNotNull()), [email], *order).unionByName(kept.where(F.col(email).isNull()))


def fold(df: DataFrame, keys: list[str], order: str, fill: list[str], arrays: list[str] = (), email: str | None = None, status: str | None = None, seen: str | None = None) -> DataFrame:
    """One row a key: first non-null of each `fill` column, sorted union of arrays, best address by status (the
    earlier in a tie), times seen, and first and last time seen. Map-side aggregation; no sort of whole groups."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fill]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays]
    if email:
        best = F.max_by(F.struct(email, status), F.when(F.col(email).isNotNull(), F.struct(status_rank(F.col(status)).alias("rank"), (-F.col(order)).alias("first"))))
        aggs.append(best.alias("_best"))
    aggs.append(F.count(F.lit(1)).alias("times_seen"))
    if seen:
        aggs += [F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select("*", F.col(f"_best.{email}").alias(email), F.col(f"_best.{status}").alias(status)).drop("_best") if email else out


def union_priority(frames: list[DataFrame], keys: list[str], *order: str) -> DataFrame:
    """All rows of several sources; of each key the row of the earliest source."""
    out = None
    for rank, f in enumerate(frames):
        f = f.withColumn("source_rank", F.lit(rank))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return first_wins(out, keys, "source_rank", *order)


def only_new(new: DataFrame, known: DataFrame, on: list[str], *order: str) -> DataFrame:
    """First row of each new key that `known` lacks. A null key is never known."""
    return first_wins(new, on, *order).join(known.select(*on).distinct(), on, "left_anti")


def upsert(current: DataFrame, changes: DataFrame, on: list[str], update: list[str], *order: str) -> DataFrame:
    """Rows of `current` with `update` columns taken from their change, and the changes without a row."""
    last = first_wins(changes, on, *order)
    take = last.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in update])
    kept = current.join(take, on, "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in current.columns])
    return kept.unionByName(last.join(current.select(*on), on, "left_anti"), allowMissingColumns=True)


def merge_write(master: DataFrame, new: DataFrame, keys: list[str], score: str) -> DataFrame:
    """K2: master rows first, then new ones, first of each key; best score on top."""
    rows = master.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_wins(rows, keys, "_src", F.desc(score)).drop("_src").orderBy(F.desc(score), *keys)
