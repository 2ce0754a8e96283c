"""Enrichment joins: group-level facts onto rows, and cascades over several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.text import email_ok

# Fixed values.
DISPOSABLE = (
    "tempmail.com", "throwaway.email", "guerrillamail.com", "mailinator.com", "yopmail.com", "trashmail.com", "fakeinbox.com", "sharklasers.com", "grr.la", "dispostable.com",
    "10minutemail.com", "temp-mail.org", "guerrillamailblock.com", "tempail.com", "mohmal.com", "getnada.com", "emailondeck.com", "maildrop.cc", "harakirimail.com", "mailnesia.com",
    "inboxkitten.com", "burnermail.io", "temp-mail.io", "mailcatch.com", "mytemp.email", "mintemail.com", "trashmail.me", "trashmail.net", "armyspy.com", "cuvox.de", "dayrep.com",
    "einrot.com", "fleckens.hu", "gustr.com", "jourrapide.com", "rhyta.com", "superrito.com", "teleworm.us",
)
ROLE_PREFIXES = (
    "info", "contact", "hello", "admin", "support", "team", "office", "press", "media", "sales", "marketing", "noreply", "no-reply", "webmaster", "postmaster", "abuse", "security",
    "billing", "help",
)


def fill_from(rows: DataFrame, facts: DataFrame, on: list[str], fill: list[str], order: str | None = None) -> DataFrame:
    """Left join, null columns filled from the first fact of the key. The join strategy is Spark's."""
    one = facts.groupBy(*on).agg(*[F.min_by(c, order).alias(f"_{c}") if order else F.max(c).alias(f"_{c}") for c in fill])
    out = rows.join(one, on, "left")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fill else F.col(c) for c in rows.columns], *[F.col(f"_{c}").alias(c) for c in fill if c not in rows.columns])


def fill_by_either(rows: DataFrame, facts: DataFrame, short: str, full: str, key: str, take: list[str]) -> DataFrame:
    """Facts by the shortened key, else by the full one."""
    a = facts.select(F.col(key).alias(short), F.lit(True).alias("_s"), *[F.col(c).alias(f"_a_{c}") for c in take])
    b = facts.select(F.col(key).alias(full), *[F.col(c).alias(f"_b_{c}") for c in take])
    out = rows.join(a, short, "left").join(b, full, "left")
    return out.select(*rows.columns, *[F.when(F.col("_s"), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in take])


def waterfall(rows: DataFrame, sources: list[DataFrame], on: list[str], columns: list[str]) -> DataFrame:
    """The columns, as a unit, of the first source whose first column isn't null; `answered_by` is its number.
    All sources meet the rows in one join; of a source's several answers for a key the least counts."""
    answers = None
    for i, s in enumerate(sources):
        one = s.where(F.col(columns[0]).isNotNull()).select(*on, F.struct(F.lit(i).alias("answered_by"), *columns).alias("_a"))
        answers = one if answers is None else answers.union(one)
    best = answers.groupBy(*on).agg(F.min("_a").alias("_a"))
    return rows.join(best, on, "left").select(*rows.columns, "_a.answered_by", *[f"_a.{c}" for c in columns])


def probe_status(status: Column, deliverable: Column, catch_all: Column) -> Column:
    """What a probe makes of a status; without an answer the status stays."""
    return F.when(deliverable & F.coalesce(catch_all, F.lit(False)), "catch_all").when(deliverable, "verified").when(~deliverable, "undeliverable").otherwise(status)


def probe_code(code: Column) -> Column:
    """C4: 250 delivers, 550 to 553 don't, anything else says nothing."""
    return F.when(code == 250, True).when(code.between(550, 553), False)


def email_quality(email: Column, has_mx: Column, dns_error: Column) -> Column:
    """Quality of an address; the first rule that applies decides. Returns (quality, disposable, role_based, retry)."""
    e = F.lower(F.trim(email))
    domain, local = F.substring_index(e, "@", -1), F.substring_index(e, "@", 1)
    ok, bad, role = email_ok(e), domain.isin(*DISPOSABLE), local.isin(*ROLE_PREFIXES)
    error = F.coalesce(dns_error, F.lit(False))
    quality = F.when(~ok, "invalid").when(bad, "low").when(role, "medium").when(error, "medium").when(~F.coalesce(has_mx, F.lit(False)), "low").otherwise("high")
    return F.struct(quality.alias("quality"), (ok & bad).alias("disposable"), (ok & ~bad & role).alias("role_based"), (ok & ~bad & ~role & error).alias("retry"))


def verdict(ok: Column, disposable: Column, role_based: Column, has_mx: Column, deliverable: Column, catch_all: Column, external: Column, external_confidence: Column) -> Column:
    """(verdict, confidence) of the verification cascade."""
    answer = lambda v, c: F.struct(F.lit(v).alias("verdict"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    conf = F.coalesce(external_confidence, F.lit(0.8))
    return (
        F.when(~ok, answer("invalid", 1.0)).when(disposable, answer("invalid", 0.95)).when(role_based, answer("risky", 0.7)).when(~has_mx, answer("invalid", 0.9))
        .when(deliverable & F.coalesce(catch_all, F.lit(False)), answer("risky", 0.6)).when(deliverable, answer("valid", 0.9)).when(~deliverable, answer("invalid", 0.95))
        .when(external, answer("valid", conf)).when(~external, answer("invalid", conf)).when(has_mx, answer("risky", 0.4)).otherwise(answer("unknown", 0.2))
    )


def snowball(seen: DataFrame, named: DataFrame, known: DataFrame, order: str = "seq") -> DataFrame:
    """Funds that a known fund's companies name as co-investors, first naming wins, known domains left out."""
    first = named.join(seen, "company", "left_semi").groupBy("fund").agg(F.min_by("company", order).alias("via"), F.min_by("domain", order).alias("domain"))
    return first.where("domain is not null").join(known.select("domain").distinct(), "domain", "left_anti")


def sample_pairs(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N of the distinct pairs (company, fund), the same ones each time: the least by a hash of the seed and the pair; a top-k,
    not a full sort."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("company").cast("string"), F.col("fund").cast("string")))
    return pairs.select("company", "fund").distinct().orderBy(h, "company", "fund").limit(n)
