"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Sources share the mix by weight, none above `max_copies` times its own words. Within a source, a document of s words
has measure ceil(sqrt(s)) and expects e = min(max_copies, k * measure) copies, with k such that the expected words meet
the source's target. Its whole part floor(e) is allocated for certain. The rest p = e - floor(e) is its inclusion
probability in a sample of fixed size: documents are ranked by (U / (1 - U)) / (p / (1 - p)) with U uniform by a hash of
the document, and the source takes the ranking's prefix whose words come nearest to what its target still lacks. The
size is fixed in words because the target is. A sample so ends within half a document of its target.

No step orders a whole source: ranks are histogrammed over RANK_BUCKETS buckets, and only the bucket that holds the end
of the prefix is sorted, to find the rank of the last document taken. From then on every row decides for itself by its
source's row of a small table. At 10^10 documents of one source that bucket has some 10^6 rows.

Null text has size 0 and is never taken; null source is a source of its own, last in order; null ids are allowed. Rows
that repeat both id and text share a rank, of which any rows are taken, as many as the target asks for. Empty input gives empty output. Other columns pass through; an input
column with the name of an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
RANK_BUCKETS = 4096
ADDED = ("size", "source_size", "target", "copies", "taken")


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Id, source, words, measure and hash of every row; the text is left out."""
    return docs.select("doc_id", "source", *own(docs, seed))


def own(docs: DataFrame, seed: str) -> list[Column]:
    size = word_count(docs["text"])
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit("")))))
    return [size.alias("size"), F.ceil(F.sqrt(size)).cast("long").alias("m"), key.alias("key")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) to targets: shares by weight, cut at max_copies times a source's size and reshared.

    A source is at its limit iff the sum over all sources of min(limit, level * weight), at the level where it reaches its
    own limit, does not exceed the total; so the loop of cutting and resharing needs no iteration.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.select("source", "source_size", weight.alias("w"))
    level = Window.orderBy(F.col("source_size") / F.col("w"))  # peers are included
    all_ = Window.partitionBy()
    s = s.select("*", F.sum("source_size").over(all_).alias("total"), F.sum("source_size").over(level).alias("below"), (F.sum("w").over(all_) - F.sum("w").over(level)).alias("w_above"))
    full = max_copies * (F.col("w") * F.col("below") + F.col("source_size") * F.col("w_above")) <= F.col("total") * F.col("w")
    s = s.withColumn("full", full)
    s = s.select("*", (F.col("total") - max_copies * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(all_), F.lit(0))).alias("left"), F.sum(F.when(~F.col("full"), F.col("w"))).over(all_).alias("w_left"))
    target = F.when(F.col("full"), (max_copies * F.col("source_size")).cast("double")).otherwise((F.col("left") * F.col("w")).cast("double") / F.col("w_left").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _expected(max_copies: int) -> Column:
    return F.when(F.col("k").isNull(), F.when(F.col("target") > 0, F.lit(float(max_copies))).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(float(max_copies)), F.col("k") * F.col("m")))


def _rank(key: Column, p: Column) -> Column:
    u = (F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)
    return (u * (1.0 - p)) / ((1.0 - u) * F.nullif(p, F.lit(0.0)))


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join rows to their source's row; null matches null."""
    b = b.withColumnRenamed("source", "_s")
    return a.join(small(b), a["source"].eqNullSafe(b["_s"]), "inner").drop("_s")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source from `sized` rows: source_size, target, k, the rank (last_q, last_key) of the last document taken,
    and last_n, how many rows of that rank are taken where not all are."""
    by_m = cut(rows.groupBy("source", "m").agg(F.sum("size").alias("words")))
    targets = cut(source_targets(by_m.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies))
    down = Window.partitionBy("source").orderBy(F.desc("m"))
    t = _same(by_m, targets)
    t = t.select("*", F.sum("words").over(down).alias("c"), (F.sum(F.col("m") * F.col("words")).over(Window.partitionBy("source")) - F.sum(F.col("m") * F.col("words")).over(down)).alias("r"))
    at_limit = (F.col("m") > 0) & (max_copies * (F.col("m") * F.col("c") + F.col("r")) <= F.col("target") * F.col("m"))
    t = t.withColumn("at_limit", at_limit)
    spread = F.nullif(F.sum(F.when(~F.col("at_limit"), F.col("m") * F.col("words"))), F.lit(0))
    k = (F.max("target") - max_copies * F.coalesce(F.sum(F.when(F.col("at_limit"), F.col("words"))), F.lit(0))) / spread
    ks = t.groupBy("source").agg(F.max("target").alias("target"), k.alias("k"))
    certain = _same(by_m, ks).groupBy("source").agg((F.max("target") - F.sum(F.floor(_expected(max_copies)) * F.col("words"))).alias("lacks"), F.max("k").alias("k"))
    sources = cut(_same(targets, certain))
    # The prefix of each source's ranking: buckets first, then the one bucket in which it ends.
    ranked = _same(rows.where("size > 0"), sources).withColumn("p", _expected(max_copies) - F.floor(_expected(max_copies))).where("p > 0")
    ranked = ranked.select("source", "size", "key", "lacks", _rank(F.col("key"), F.col("p")).alias("q"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1.0 + F.col("q")) * RANK_BUCKETS))
    hist = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("lacks").alias("lacks"))
    run = Window.partitionBy("source").orderBy("bucket")
    hist = cut(hist.select("*", (F.sum("words").over(run) - F.col("words")).alias("before")).where("before < lacks"))
    last = hist.groupBy("source").agg(F.max_by("bucket", "bucket").alias("b"), F.max_by("before", "bucket").alias("before"))
    # Rows that repeat id and text share a rank: of the last rank so many are taken as come nearest.
    within = _same(ranked, last).where("bucket = b").groupBy("source", "q", "key", "size", "lacks", "before").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("q", "key").rowsBetween(Window.unboundedPreceding, -1)
    within = within.withColumn("lacks", F.col("lacks") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    within = within.withColumn("t", F.least("n", F.floor(F.col("lacks") / F.col("size") + 0.5)))
    ends = within.where("t > 0").groupBy("source").agg(F.max(F.struct("q", "key", "t", "n")).alias("e"))
    ends = ends.select("source", F.col("e.q").alias("last_q"), F.col("e.key").alias("last_key"), F.when(F.col("e.t") < F.col("e.n"), F.col("e.t")).alias("last_n"))
    ends = cut(last.join(ends, last["source"].eqNullSafe(ends["source"]), "left").select(last["source"], "b", "last_q", "last_key", "last_n"))
    out = sources.join(small(ends.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "lacks")
    return cut(out)


def _at_end() -> Column:
    """Whether a row has the rank of which not all rows are taken."""
    return F.col("last_n").isNotNull() & (F.col("key") == F.col("last_key"))


def _copies(max_copies: int) -> Column:
    e = _expected(max_copies)
    p = e - F.floor(e)
    q = _rank(F.col("key"), p)
    bucket = F.floor(q / (1.0 + q) * RANK_BUCKETS)
    # Buckets before the last are taken whole; in the last, what ranks up to the last document taken.
    more = (F.col("size") > 0) & (p > 0) & F.coalesce((bucket < F.col("b")) | ((bucket == F.col("b")) & ((q < F.col("last_q")) | ((q == F.col("last_q")) & (F.col("key") <= F.col("last_key")) & (F.coalesce(F.col("last_n"), F.lit(1)) >= F.when(_at_end(), F.col("ordinal")).otherwise(F.lit(1)))))), F.lit(False))
    return F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(e).cast("int") + F.when(more, 1).otherwise(0)).cast("int")


def decide(rows: DataFrame, sources: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add source_size, target, copies and taken to rows that have source, size, m and key."""
    out = _same(rows, sources)
    if sources.where("last_n is not null").isEmpty():
        out = out.withColumn("ordinal", F.lit(1))
    else:
        number = F.row_number().over(Window.partitionBy("source", "key").orderBy(F.lit(1)))
        out = out.where(~_at_end()).withColumn("ordinal", F.lit(1)).unionByName(out.where(_at_end()).withColumn("ordinal", number))
    out = out.withColumn("copies", _copies(max_copies))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("k", "b", "last_q", "last_key", "last_n", "ordinal", "m", "key")


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """Every row of `docs` with size, source_size, target, copies (how often the mix takes it) and taken (copies * size)."""
    sources = plan(cut(sized(docs, seed)), weights, max_copies)
    keep = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*keep).alias("row"), "source", *own(docs, seed))
    return decide(rows, sources, max_copies).select("row.*", *ADDED)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of `docs`."""
    out = pareto_mix(docs, **how).where("copies > 0")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
