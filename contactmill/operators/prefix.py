"""Ranks, running sums and folds along an order, without a task that sees a whole group.

Spark sorts the rows over range partitions; the result is stored with each row's block (its partition) and place in it. What a
block adds up to is one row a block and key, and what stands before a block is a window over those few rows. So neither a
table's order nor a key that holds a third of all rows is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.session import new_folder

#: Bits of a row's place in `monotonically_increasing_id`.
_PLACE = 33


def ordered(df: DataFrame, order: list[Column | str], blocks: int | None = None) -> DataFrame:
    """The rows sorted over range partitions and stored, with `_block` and `_at`. The order must be total; `blocks` asks for so
    many partitions instead of leaving them to Spark."""
    rows = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order) if blocks else df.orderBy(*order)
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    path = new_folder(df.sparkSession, "ordered")
    rows.select(*df.columns, F.shiftright("_id", _PLACE).alias("_block"), F.col("_id").bitwiseAND(F.lit((1 << _PLACE) - 1)).alias("_at")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _before(rows: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """(_block, keys, totals of the key's blocks before). One row a block and key."""
    per = rows.groupBy("_block", *keys).agg(*[v.alias(k) for k, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_block", *keys, *[F.sum(k).over(before).alias(k) for k in totals])


def rank(df: DataFrame, order: list[Column | str], name: str = "rank", blocks: int | None = None) -> DataFrame:
    """Number of each row in the order of the whole table, from 1."""
    rows = ordered(df, order, blocks)
    counts = _before(rows, [], _n=F.count(F.lit(1)))  # as many rows as there are partitions
    out = rows.join(F.broadcast(counts), "_block")
    return out.select(*df.columns, (F.coalesce("_n", F.lit(0)) + F.col("_at") + 1).alias(name))


def chunks(df: DataFrame, order: list[Column | str], size: int, name: str = "batch", blocks: int | None = None) -> DataFrame:
    """Number of the batch of `size` rows, counted over the whole table, from 0."""
    out = rank(df, order, "_rank", blocks)
    return out.select(*df.columns, F.floor((F.col("_rank") - 1) / size).cast("long").alias(name))


def ledger(df: DataFrame, user: str, amount: str, order: list[str], reset: Column | None = None, opening: int = 0, blocks: int | None = None) -> DataFrame:
    """Balance after each entry of a user, which starts at `opening` and never falls below zero, and what an entry spends:
    what it asks for (a negative amount), or what is left if that is less. Where `reset` holds the amount replaces the
    balance, as a plan's refill does. Null amounts count as zero.

    Without the floor the balance is the running sum S; with it, S less the least of S so far and of -opening.
    """
    entry = F.coalesce(F.col(amount), F.lit(0)).cast("long")
    again = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    rows = ordered(df.select("*", entry.alias("_a"), again.alias("_r")), [user, *order], blocks)
    key = Window.partitionBy("_block", user).orderBy("_at")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    # A reset begins a part of its own, whose opening is its amount.
    parts = _before(rows, [user], _seen=F.count_if("_r"))
    rows = rows.withColumn("_p", F.count_if("_r").over(so_far(key))).join(parts.withColumnRenamed(user, "_u"), (F.col(user).eqNullSafe(F.col("_u"))) & (rows["_block"] == parts["_block"]), "left").drop(parts["_block"]).drop("_u")
    rows = rows.withColumn("_p", F.col("_p") + F.coalesce("_seen", F.lit(0))).drop("_seen")
    rows = rows.withColumns({"_open": F.when(F.col("_r"), F.greatest(F.col("_a"), F.lit(0))), "_a": F.when(F.col("_r"), 0).otherwise(F.col("_a"))})
    part = Window.partitionBy("_block", user, "_p").orderBy("_at")
    rows = rows.withColumn("_s", F.sum("_a").over(so_far(part)))
    # Of each block and part: its sum, its least running sum, its opening if it begins here.
    per = rows.groupBy("_block", user, "_p").agg(F.sum("_a").alias("_sum"), F.min("_s").alias("_low"), F.max("_open").alias("_o"))
    earlier = Window.partitionBy(user, "_p").orderBy("_block")
    before = lambda c: F.sum(c).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_off", F.coalesce(before("_sum"), F.lit(0)))
    per = per.select(F.col("_block").alias("_b2"), F.col(user).alias("_u2"), F.col("_p").alias("_p2"), "_off", F.min(F.col("_off") + F.col("_low")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_lowest"), F.coalesce(F.max("_o").over(Window.partitionBy(user, "_p")), F.lit(opening)).alias("_open"))
    rows = rows.drop("_open").join(per, (F.col("_block") == F.col("_b2")) & F.col(user).eqNullSafe(F.col("_u2")) & (F.col("_p") == F.col("_p2")), "left")
    s = F.col("_off") + F.col("_s")
    # F.least and F.greatest pass over nulls.
    lowest = lambda frame: F.least(-F.col("_open"), F.col("_lowest"), F.min("_s").over(frame) + F.col("_off"))
    now, then = lowest(so_far(part)), lowest(part.rowsBetween(Window.unboundedPreceding, -1))
    balance = F.when(F.col("_r"), F.col("_open")).otherwise(s - now)
    spent = F.when(~F.col("_r") & (F.col("_a") < 0), -F.col("_a") - (then - now)).otherwise(0)
    return rows.select(*df.columns, balance.cast("long").alias("balance_after"), spent.cast("long").alias("spent"))


def counts_before(rows: DataFrame, key: str, **totals: Column) -> DataFrame:
    """Rows of `ordered` with, for each named condition, how many earlier rows of the key meet it."""
    here = Window.partitionBy("_block", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.count_if(c).over(here).alias(f"_h_{k}") for k, c in totals.items()])
    before = _before(rows, [key], **{k: F.count_if(c) for k, c in totals.items()}).withColumnsRenamed({"_block": "_b", key: "_k"} | {k: f"_b_{k}" for k in totals})
    out = rows.join(before, (F.col("_block") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")), "left").drop("_b", "_k")
    return out.select(*[c for c in rows.columns if not c.startswith("_h_")], *[(F.col(f"_h_{k}") + F.coalesce(f"_b_{k}", F.lit(0))).alias(k) for k in totals])
