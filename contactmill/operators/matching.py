"""Addresses to people of one domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions import text as t
from contactmill.session import new_folder

THRESHOLD = 0.3
#: Letters that a local part has at most.
LOCAL = 64


def name_pairs(people: DataFrame, emails: DataFrame) -> DataFrame:
    """(domain, seq, first, last, email) of people (domain, seq, first, last) and the addresses (domain, email) of their
    domain whose local part contains the first or last name; all others score 0. Whole names meet the pieces of the local
    parts that are as long as some name, so a joined pair is a pair of the result, and common beginnings pair nothing.
    People of one name are joined as one."""
    names = people.select("domain", "first", "last").distinct()
    parts = names.select("domain", F.explode(F.array("first", "last")).alias("piece")).where("piece != ''").distinct()
    # At most as many numbers as a local part has letters; longer names are in no address.
    sizes = sorted(r[0] for r in parts.select(F.length("piece").alias("n")).where(F.col("n") <= LOCAL).distinct().collect())
    local = F.lower(F.substring_index("email", "@", 1))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(local) - n + 1), lambda i: F.substring(local, i, n))
    pieces = F.flatten(F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length(local)), cut))
    at = emails.select("domain", "email").distinct().select("domain", "email", F.explode(F.array_distinct(pieces)).alias("piece"))
    hits = parts.join(at, ["domain", "piece"])
    by = lambda c: names.join(hits.withColumnRenamed("piece", c), ["domain", c]).select("domain", "first", "last", "email")
    found = by("first").union(by("last")).distinct()
    return people.select("domain", "seq", "first", "last").join(found, ["domain", "first", "last"]).select("domain", "seq", "first", "last", "email")


def greedy_match(people: DataFrame, found: DataFrame, score: str = "score", threshold: float = THRESHOLD, alike: list[str] | None = None) -> DataFrame:
    """One address for each person: people in order take the best one still free, at `threshold` or above; of equal scores
    the address that sorts first. Returns (domain, seq, email).

    People (domain, seq, the columns `alike`) that agree in `alike` share one list of addresses, `found` (domain, the columns
    `alike`, email, score); by default each person has an own one, by seq. Repeated people count once.

    The same result by deferred acceptance in rounds: everyone stands at a place of their list, an address keeps the earliest of
    those who stand there, and the others move on to the next place that no earlier one holds. Who has left a place has
    left it to someone earlier, so with one order for all nobody moves too far, and the end is the one of taking turns.
    Of people with one list, the n-th in order gets a later place than the one before, so they move on together. A round is
    a few joins; what it starts from is stored.
    """
    alike = alike or ["seq"]
    spark, folder, count = people.sparkSession, new_folder(people.sparkSession, "match"), iter(range(1 << 30))

    def put(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(count)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    list_key = F.md5(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in alike])).alias("list")
    place = F.row_number().over(Window.partitionBy("domain", "list").orderBy(F.desc(score), "email"))
    lists = found.where(F.col(score) >= threshold).select("domain", list_key, "email", score).groupBy("domain", "list", "email").agg(F.max(score).alias(score))
    lists = put(lists.select("domain", "list", "email", place.alias("place")))
    number = F.row_number().over(Window.partitionBy("domain", "list").orderBy("seq"))
    standing = people.select("domain", "seq", list_key).distinct().join(lists.select("domain", "list").distinct(), ["domain", "list"], "left_semi")
    standing = put(standing.select("domain", "list", "seq", number.alias("n")).withColumn("place", F.col("n")))
    while True:
        at = standing.join(lists, ["domain", "list", "place"])  # who stands behind the end of the list is gone
        holders = at.groupBy("domain", "email").agg(F.min("seq").alias("holder"))
        at = put(at.join(holders, ["domain", "email"]).select("domain", "list", "seq", "n", "place", "email", "holder"))
        lost = at.where("seq > holder")
        if lost.isEmpty():
            return at.select("domain", "seq", "email")
        held = at.where("seq = holder").select("domain", "email", "holder")
        ahead = lost.select("domain", "list", "seq", F.col("place").alias("left_at")).join(lists, ["domain", "list"]).where("place > left_at")
        free = ahead.join(held, ["domain", "email"], "left").where("holder is null or holder > seq")
        moved = free.groupBy("domain", "list", "seq").agg(F.min("place").alias("to"))
        # Without a free place: behind the end. Then nobody stands before or beside an earlier one of the same list.
        end = lists.groupBy("domain", "list").agg((F.max("place") + 1).alias("end"))
        now = at.select("domain", "list", "seq", "n", "place", (F.col("seq") > F.col("holder")).alias("out")).join(moved, ["domain", "list", "seq"], "left").join(end, ["domain", "list"])
        now = now.withColumn("place", F.when(F.col("out"), F.coalesce("to", "end")).otherwise(F.col("place")))
        least = F.max(F.col("place") - F.col("n")).over(Window.partitionBy("domain", "list").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
        standing = put(now.withColumn("place", F.col("n") + least).where("place < end").select("domain", "list", "seq", "n", "place"))


def best_match(pairs: DataFrame, score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """The relaxed form of J8: best address of each person, addresses may repeat. No Python."""
    w = Window.partitionBy("domain", "seq").orderBy(F.desc(score), "email")
    return pairs.where(F.col(score) >= threshold).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def leftovers(people: DataFrame, emails: DataFrame) -> DataFrame:
    """The n-th address left over goes to the n-th person left over of its domain."""
    a = people.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("seq")))
    b = emails.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("pos", "email")))
    return a.join(b, ["domain", "n"], "left").drop("n", "pos")


def last_by_key(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def prefer_domain(people: DataFrame, found: DataFrame) -> DataFrame:
    """Of a name's addresses the first on the person's own domain, else the first."""
    j = people.join(found, "name")
    own = F.lower(F.substring_index("email", "@", -1)) == F.col("domain")
    return j.groupBy("seq", "name", "domain").agg(F.min_by("email", F.struct(F.when(own, 0).otherwise(1).alias("other"), "pos")).alias("email"))


def url_for_name(people: DataFrame, urls: DataFrame) -> DataFrame:
    """First profile link of the page that contains the first six letters of the squashed name."""
    p = people.withColumn("_p", F.left(t.ascii_letters(F.col("name")), F.lit(6))).where("_p != ''")
    j = p.join(urls, "page_id").where(F.contains(F.lower("url"), F.col("_p")))
    return j.groupBy("page_id", "name").agg(F.min_by("url", "pos").alias("url"))


def link_for_name(people: DataFrame, links: DataFrame) -> DataFrame:
    """First link whose text holds the name or is held by it, else whose path holds the name with dashes or squashed."""
    name, label = F.lower(F.trim("name")), F.lower(F.trim("label"))
    dashed, squashed = F.regexp_replace(name, r"\s+", "-"), F.regexp_replace(name, r"\s+", "")
    path = t.url_path(F.col("url"))
    hit = ((label != "") & (F.contains(label, name) | F.contains(name, label))) | F.contains(path, dashed) | F.contains(path, squashed)
    j = people.join(links, "page_id").where(hit & (t.host(F.col("url")) == F.col("host")))
    return j.groupBy("page_id", "name").agg(F.min_by("url", "pos").alias("url"))
