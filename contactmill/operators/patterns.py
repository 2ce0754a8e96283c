"""Address patterns: generation, detection, learning, confidence, ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions.text import let

# Patterns by prevalence.
PATTERNS = ("{first}.{last}@{domain}", "{first}@{domain}", "{f}{last}@{domain}", "{first}{last}@{domain}", "{f}.{last}@{domain}", "{last}@{domain}", "{first}_{last}@{domain}", "{last}.{first}@{domain}")

# How often each pattern is met.
BASE_RATES = {
    "{first}@{domain}": 0.41, "{f}{last}@{domain}": 0.26, "{last}@{domain}": 0.14, "{first}.{last}@{domain}": 0.05, "{first}{last}@{domain}": 0.04, "{f}.{last}@{domain}": 0.03,
    "{first}_{last}@{domain}": 0.02, "{last}.{first}@{domain}": 0.01,
}
COMMONEST = "{first}@{domain}"


def candidates(first: Column, last: Column, domain: Column) -> Column:
    """G1: array of (pattern, email) in order; empty if a name part is."""
    part = {"{first}": first, "{last}": last, "{f}": F.left(first, F.lit(1)), "{domain}": domain}
    out = []
    for p in PATTERNS:
        pieces = [part[x] if x in part else F.lit(x) for x in re.split(r"(\{\w+\})", p) if x]
        out.append(F.struct(F.lit(p).alias("pattern"), F.concat(*pieces).alias("email")))
    ok = (F.coalesce(first, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "") & domain.isNotNull()
    return F.when(ok, F.array(*out)).otherwise(F.expr("cast(array() as array<struct<pattern:string,email:string>>)"))


def expand(df: DataFrame, first: str, last: str, domain: str, email: str = "email", status: str = "email_status") -> DataFrame:
    """Up to eight rows a person; rows with a known address, or without names, pass as they are."""
    own = F.array(F.struct(F.lit(None).cast("string").alias("pattern"), F.col(email).alias("email")))
    take = let(candidates(F.col(first), F.col(last), F.col(domain)), lambda c: F.when(F.col(status).isin("verified", "scraped") | (F.size(c) == 0), own).otherwise(c))
    return df.withColumn("_c", F.explode(take)).withColumns({email: F.col("_c.email"), "pattern": F.col("_c.pattern")}).drop("_c")


def detect(email: Column, first: Column, last: Column) -> Column:
    """The first pattern that gives the address; null if none does."""
    parts = F.struct(F.lower(email).alias("email"), F.lower(F.substring_index(email, "@", -1)).alias("domain"))
    return let(parts, lambda e: F.get(F.filter(candidates(first, last, e["domain"]), lambda x: x["email"] == e["email"]), F.lit(0))["pattern"])


def learn(observed: DataFrame, weight: str | None = None) -> DataFrame:
    """Best pattern of each domain by summed weight, the one seen first in a tie; with total and share.

    `observed`: (domain, pattern, seq)."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = observed.where("pattern is not null").groupBy("domain", "pattern").agg(n.cast("long").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy("domain").agg(F.max_by("pattern", F.struct("n", -F.col("first"))).alias("pattern"), F.max("n").alias("best"), F.sum("n").alias("total"))


def confidence(total: Column, best: Column) -> Column:
    """(source, confidence) of a domain's learned pattern; null total means that there is none."""
    share = best / total
    lock, hint = F.least(F.lit(0.92), 0.70 + 0.10 * total), F.least(F.lit(0.75), 0.50 + 0.08 * total)
    answer = lambda s, c: F.struct(F.lit(s).alias("source"), c.alias("confidence"))
    return F.when(total.isNull(), answer("base_rate", F.lit(None).cast("double"))).when((total >= 2) & (share >= 0.67), answer("domain_lock", lock)).otherwise(answer("domain_hint", hint))


def candidate_score(pattern: Column, learned: Column, source: Column, base_rate: Column, has_mx: Column) -> Column:
    """Confidence in one candidate, four decimals."""
    fits = F.when(source == "domain_lock", 0.90).when(source == "domain_hint", 0.72).otherwise(base_rate)
    return F.round(F.when(pattern == learned, fits).otherwise(base_rate * 0.6) * F.when(has_mx, 1.0).otherwise(0.3), 4)


def base_rate(pattern: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASE_RATES.items() for x in kv]), pattern), F.lit(0.02))


def rank_addresses(people: DataFrame, learned: DataFrame, scraped: DataFrame, n: int = 2) -> DataFrame:
    """People (domain, seq, first, last, has_mx) with their likeliest addresses: pattern, email, source, score,
    tier and rank, and the confidence in their domain's pattern.

    A scraped address (domain, seq, email) passes through, with that confidence and 0.15 more, 0.98 at most, or 0.6 where the domain takes
    no mail; its pattern is `other` if it has none. The others get the n best of eight candidates. `learned`: as of `learn`; domains without
    it go by base rates, as if the commonest pattern were theirs. Unknown mail service counts as service."""
    mine = learned.select("domain", F.col("pattern").alias("_lp"), "best", "total")
    rows = people.withColumn("has_mx", F.coalesce("has_mx", F.lit(True))).join(mine, "domain", "left").join(scraped.select("domain", "seq", F.col("email").alias("_own")), ["domain", "seq"], "left")
    sure = confidence(F.col("total"), F.col("best"))
    rows = rows.withColumns({"_source": sure["source"], "confidence": F.coalesce(sure["confidence"], F.lit(BASE_RATES[COMMONEST])), "_lp": F.coalesce("_lp", F.lit(COMMONEST))})
    keep = ["domain", "seq", "confidence"]
    own = rows.where("_own is not null")
    passed = F.when(F.col("has_mx"), F.least(F.lit(0.98), F.col("confidence") + 0.15)).otherwise(0.6)
    own = own.select(*keep, F.coalesce(detect(F.col("_own"), F.col("first"), F.col("last")), F.lit("other")).alias("pattern"), F.col("_own").alias("email"), F.lit("scraped").alias("source"), passed.alias("score"), F.lit(1).alias("rank"))
    rest = rows.where("_own is null").select(*keep, "_source", "_lp", "has_mx", F.explode(candidates(F.col("first"), F.col("last"), F.col("domain"))).alias("c"))
    rest = rest.select(*keep, "c.pattern", "c.email", F.col("_source").alias("source"), candidate_score(F.col("c.pattern"), F.col("_lp"), F.col("_source"), base_rate(F.col("c.pattern")), F.col("has_mx")).alias("score"))
    out = own.unionByName(top(rest, ["domain", "seq"], n).select(*keep, "pattern", "email", "source", "score", "rank"))
    return out.withColumn("tier", confidence_tier(F.col("score")))


def confidence_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.40, "MEDIUM").otherwise("LOW")


def top(df: DataFrame, person: list[str], n: int = 2) -> DataFrame:
    """The n best candidates of each person by score, pattern, address, all descending."""
    w = Window.partitionBy(*person).orderBy(F.desc("score"), F.desc("pattern"), F.desc("email"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def statistics(observed: DataFrame) -> DataFrame:
    """Share of each pattern over all domains, three decimals."""
    per = observed.where("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("domains"))
    return per.select("*", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 3).alias("share"))  # one row a pattern


def levels(rows: DataFrame, group: str, value: str, order: str, top: int = 50) -> DataFrame:
    """Counts of values in all, in each group and of each value, from one pass with grouping sets.

    `rows`: (group, value, order), one an observation; null values are none. Rows of the result: level "total" (n, and `groups`), level "value"
    (n and its share of all), and level "group": the `top` groups of most observations with their commonest value
    and its share. Among equals the one seen first comes first. Shares have three decimals."""
    seen = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"), F.col(order).alias("o"))
    sets = seen.groupingSets([["g", "v"], ["v"], []], "g", "v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"), F.grouping_id("g", "v").alias("set"))
    # 0: group and value, 2: value, 3: all. What follows is made of counts alone.
    cells = sets.where("set = 0")
    groups = cells.groupBy("g").agg(F.max_by("v", F.struct("n", -F.col("first"))).alias("v"), F.max("n").alias("best"), F.sum("n").alias("n"), F.min("first").alias("first"))
    null = lambda kind: F.lit(None).cast(kind)
    kinds = dict(seen.dtypes)
    best = groups.orderBy(F.desc("n"), "first").limit(top).select(F.lit("group").alias("level"), F.col("g").alias(group), F.col("v").alias(value), "n", null("long").alias("groups"), F.round(F.col("best") / F.col("n"), 3).alias("share"))
    total = sets.where("set = 3").select(F.lit("total").alias("level"), null(kinds["g"]).alias(group), null(kinds["v"]).alias(value), "n").crossJoin(groups.agg(F.count(F.lit(1)).alias("groups"))).withColumn("share", F.when(F.col("n") > 0, 1.0))  # one row each
    of = F.broadcast(total.select(F.col("n").alias("_all")))  # one row
    values = sets.where("set = 2").join(of).select(F.lit("value").alias("level"), null(kinds["g"]).alias(group), F.col("v").alias(value), "n", null("long").alias("groups"), F.round(F.col("n") / F.col("_all"), 3).alias("share"))
    return best.unionByName(values).unionByName(total)


def sample(df: DataFrame, n: int, seed: int, key: str = "email") -> DataFrame:
    """N rows, the same ones each time, by a hash of the seed and the key; a top-k, not a full sort."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), key)), key).limit(n)
