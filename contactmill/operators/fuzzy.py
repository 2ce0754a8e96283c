"""Near-equal names. Exact keys first; then candidate pairs by what is left of the names without a few letters, or by rare
pieces of them, none of which is missed."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.session import new_folder

#: Letters in a piece.
Q = 2
#: Letters that names lose at most to meet by what is left of them, and letters of such names at most.
CUTS, LONGEST = 2, 64


@F.pandas_udf(T.DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, for candidate pairs only. What difflib prepares of the second name serves the next pairs too."""
    out, match, last = [], SequenceMatcher(), None
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            match.set_seq2(y)
            last = y
        match.set_seq1(x)
        out.append(match.ratio())
    return pd.Series(out, dtype="float64")


def _pieces(c: Column) -> Column:
    """All pieces of Q letters of a name, each with its number among equal ones."""
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - Q + 1)), lambda i: F.substring(c, i, Q))
    number = lambda a, g, i: F.size(F.filter(F.slice(a, F.lit(1), i), lambda x: x == g))
    return F.element_at(F.transform(F.array(all_), lambda a: F.transform(a, lambda g, i: F.concat_ws("#", g, number(a, g, i)))), 1)


def _candidates(names: DataFrame, block: list[str], edits: Column, short: int = 0) -> DataFrame:
    """(left, right, lo): pairs of `names` (name, o, block) that may be within `edits` letters of each other, lo the earlier.

    One letter more or less changes Q pieces at most, so two such names have one of their Q * edits + 1 rarest pieces in
    common. Where names of up to `short` letters may have none in common, they are compared with each other."""
    rows = names.withColumn("e", edits.cast("int")).select("*", F.explode(_pieces(F.col("name"))).alias("piece"))
    counts = rows.groupBy(*block, "piece").agg(F.count(F.lit(1)).alias("c"))
    rare = rows.join(counts, [*block, "piece"]).groupBy("name", "o", "e", *block).agg(F.array_sort(F.collect_list(F.struct("c", "piece"))).alias("p"))
    rare = rare.select("name", "o", *block, F.slice("p", F.lit(1), Q * F.col("e") + 1)["piece"].alias("p"))
    tokens = F.when(F.length("name") <= short, F.array_append("p", F.lit("short"))).otherwise(F.col("p"))
    rare = rare.select("name", "o", *block, F.explode(tokens).alias("token"))
    a = rare.select(*block, "token", F.col("name").alias("left"), F.col("o").alias("lo"))
    b = rare.select(*block, "token", F.col("name").alias("right"), F.col("o").alias("ro"))
    return a.join(b.hint("merge"), [*block, "token"]).where("lo < ro").select("left", "right", "lo").distinct()


def similar_pairs(df: DataFrame, key: str, order: str, block: list[str], most: int = 2) -> DataFrame:
    """(left, right, lo, distance): distinct keys of one block, at most `most` edits apart, left the earlier. Keys are made
    distinct first, so copies of a name cost nothing; an edit replaces a letter at most, which is two letters' change."""
    names = df.groupBy(F.col(key).alias("name"), *block).agg(F.min(order).alias("o"))
    pairs = _candidates(names, block, F.lit(most), Q * most + Q + most)
    return pairs.withColumn("distance", F.levenshtein("left", "right", most)).where("distance between 0 and " + str(most))


def _unmatched(n: Column, m: Column, least: float) -> Column:
    """Letters of two names of n and m letters that may be unmatched, of both together."""
    return F.floor((n + m) * (1 - least) + 1e-9).cast("int")


def _cuts(n: Column, m: Column, least: float) -> Column:
    """Letters that the longer of two names loses at most until what both have in common is left; the shorter loses
    as many less as it is shorter."""
    gap = F.abs(n - m)
    return gap + F.floor((_unmatched(n, m, least) - gap) / 2).cast("int")


def _by_cuts(n: Column, m: Column, least: float) -> Column:
    """Whether names of these lengths meet by what is left of them."""
    return (_cuts(n, m, least) <= CUTS) & (F.greatest(n, m) <= LONGEST)


def _lengths(n: Column, least: float) -> Column:
    """All lengths of names that a name of n letters may be similar to."""
    some = F.sequence(F.ceil(n * (least / (2 - least)) - 1e-9).cast("int"), F.floor(n * ((2 - least) / least) + 1e-9).cast("int"))
    return F.filter(some, lambda m: F.abs(n - m) <= _unmatched(n, m, least))


def _left_over(name: Column, cuts: Column) -> Column:
    """All that is left of a name that loses so many letters, up to CUTS."""
    lose = lambda x: F.transform(F.sequence(x["from"], F.length(x["s"])), lambda i: F.struct(F.concat(F.left(x["s"], i - 1), F.substr(x["s"], i + 1)).alias("s"), i.alias("from")))
    left = [F.array(F.struct(name.alias("s"), F.lit(1).alias("from")))]
    for _ in range(CUTS):
        left.append(F.flatten(F.transform(F.filter(left[-1], lambda x: x["from"] <= F.length(x["s"])), lose)))
    out = F.when(cuts == 0, left[0]["s"])
    for i in range(1, CUTS + 1):
        out = out.when(cuts == i, left[i]["s"])
    return F.array_distinct(out)


def _alike(names: DataFrame, least: float) -> DataFrame:
    """(left, right, lo): pairs of `names` (name, o) whose lengths meet `_by_cuts`, lo the earlier, with at least as long a common
    subsequence as the ratio asks for.

    Where of n and m letters k may be unmatched, the longer loses gap + (k - gap) / 2 letters and the shorter (k - gap) / 2, and
    one of the names that are left is the same. They meet by its hash; the ratio decides later, so equal hashes add no pair."""
    n = F.length("name")
    # A name becomes hundreds of rows: they are dealt out where Spark, which goes by their bytes, would take one task.
    dealt = names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.select("name", "o", n.alias("n"), F.explode(_lengths(n, least)).alias("m")).where(_by_cuts(F.col("n"), F.col("m"), least))
    most, gap = _cuts(F.col("n"), F.col("m"), least), F.abs(F.col("n") - F.col("m"))

    def side(rows: DataFrame, cuts: Column, short: str, long: str, o: str) -> DataFrame:
        return rows.select(short, long, F.col("o").alias(o), F.explode(_left_over(F.col("name"), cuts)).alias("s")).select(F.xxhash64("s", short, long).alias("h"), o)

    # Spark's estimate of a table does not grow where arrays are exploded, so it would broadcast either side.
    pairs = side(rows.where("n <= m"), most - gap, "n", "m", "a").join(side(rows.where("n >= m"), most, "m", "n", "b").hint("merge"), "h").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("ro")).distinct()
    of = lambda name, o: names.select(F.col("name").alias(name), F.col("o").alias(o))
    return pairs.join(of("left", "lo"), "lo").join(of("right", "ro"), "ro").select("left", "right", "lo")


def ratio_pairs(df: DataFrame, key: str, order: str, least: float = 0.95) -> DataFrame:
    """(left, right, lo, ratio): distinct keys whose ratio of matching blocks is `least` or more, left the earlier.

    Of both names' letters at most (1 - least) are unmatched, and the longer has at most (2 - least) / least times the
    shorter's; so a name of n letters meets at most n * 2 * (1 - least) / least unmatched ones. Names of lengths that leave few
    letters unmatched meet by what is left without those; others by rare pieces, if as few edits make them equal."""
    names = df.groupBy(F.col(key).alias("name")).agg(F.min(order).alias("o"))
    n, a, b = F.length("name"), F.length("left"), F.length("right")
    rest = names.where(F.exists(_lengths(n, least), lambda m: ~_by_cuts(n, m, least)))
    rest = _candidates(rest, [], F.floor(n * (2 * (1 - least) / least) + 1e-9)).where((F.abs(a - b) <= _unmatched(a, b, least)) & ~_by_cuts(a, b, least))
    rest = rest.where(F.levenshtein("left", "right") <= _unmatched(a, b, least))
    return _alike(names, least).unionByName(rest).withColumn("ratio", difflib_ratio("left", "right")).where(F.col("ratio") >= least)


def merge_similar(df: DataFrame, key: str, order: str, least: float = 0.95) -> DataFrame:
    """Each row with `merged_key`: in order, a key is merged into the first accepted key before it that is similar, and
    accepted itself if there is none. Not transitive. Each round decides all keys whose similar earlier ones are decided."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "similar")
    ratio_pairs(df, key, order, least).select("left", "right", "lo").write.parquet(f"{folder}/pairs")
    pairs, merged, step = spark.read.parquet(f"{folder}/pairs"), None, 0
    open_ = pairs
    while not open_.isEmpty():
        # Keys without an open earlier one are accepted; what is similar to them is merged.
        now = open_.join(open_.select(F.col("right").alias("left")).distinct(), "left", "left_anti").select("right").distinct()
        now.write.parquet(f"{folder}/merged-{step}")
        now = spark.read.parquet(f"{folder}/merged-{step}")
        merged = now if merged is None else merged.union(now)
        open_.join(now, "right", "left_anti").join(now.withColumnRenamed("right", "left"), "left", "left_anti").write.parquet(f"{folder}/open-{step}")
        open_, step = spark.read.parquet(f"{folder}/open-{step}"), step + 1
    if merged is None:
        return df.withColumn("merged_key", F.col(key))
    use = pairs.join(merged, "right").join(merged.withColumnRenamed("right", "left"), "left", "left_anti")
    first = use.groupBy("right").agg(F.min_by("left", "lo").alias("merged_key"))
    return df.join(first.withColumnRenamed("right", key), key, "left").withColumn("merged_key", F.coalesce("merged_key", F.col(key)))
