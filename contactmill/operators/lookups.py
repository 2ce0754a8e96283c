"""Address lookups as relations (E1 to E14, J4, J11, P40): what an outside service would answer comes in as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import text as t

from . import matching, patterns, prefix

# Mail providers by a part of the SPF include or of the MX host, in order, and the pattern each suggests.
SPF_PROVIDERS = (
    ("_spf.google.com", "google_workspace"), ("google.com", "google_workspace"), ("googlemail.com", "google_workspace"), ("spf.protection.outlook.com", "microsoft_365"),
    ("outlook.com", "microsoft_365"), ("pphosted.com", "proofpoint"), ("mimecast", "mimecast"), ("sendgrid.net", "sendgrid"), ("amazonses.com", "amazon_ses"),
    ("mailgun.org", "mailgun"), ("zendesk.com", "zendesk"), ("freshdesk.com", "freshdesk"),
)
MX_PROVIDERS = (
    ("google.com", "google_workspace"), ("googlemail.com", "google_workspace"), ("outlook.com", "microsoft_365"), ("protection.outlook.com", "microsoft_365"), ("pphosted.com", "proofpoint"),
    ("mimecast.com", "mimecast"), ("barracuda", "barracuda"), ("protonmail.ch", "protonmail"), ("zoho.com", "zoho"), ("fastmail", "fastmail"), ("migadu.com", "migadu"),
    ("improvmx.com", "improvmx"), ("forwardemail.net", "forward_email"),
)
PROVIDER_PATTERNS = {"google_workspace": "{first}.{last}@{domain}", "microsoft_365": "{first}.{last}@{domain}", "protonmail": "{first}@{domain}", "zoho": "{first}.{last}@{domain}", "fastmail": "{first}@{domain}"}
VENDOR_PATTERNS = {
    "first.last": "{first}.{last}@{domain}", "first_last": "{first}_{last}@{domain}", "firstlast": "{first}{last}@{domain}", "first": "{first}@{domain}", "flast": "{f}{last}@{domain}",
    "f.last": "{f}.{last}@{domain}", "last": "{last}@{domain}", "last.first": "{last}.{first}@{domain}", "lastfirst": "{last}{first}@{domain}",
}
DNS_WEIGHT, VENDOR_WEIGHT, VENDOR_LEAST = 2, 5, 70


def _first_part(host: Column, providers: tuple[tuple[str, str], ...]) -> Column:
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in providers])
    return F.get(F.filter(table, lambda p: F.contains(host, p["k"])), F.lit(0))["v"]


def provider(txt: Column, mx: Column) -> Column:
    """The mail provider: by the SPF includes of the TXT text in order, else by the MX hosts (an array) in order."""
    first = lambda hosts, table: F.get(F.filter(F.transform(hosts, lambda h: _first_part(h, table)), lambda p: p.isNotNull()), F.lit(0))
    includes = F.regexp_extract_all(F.lower(F.coalesce(txt, F.lit(""))), F.lit(r'include:([^\s"]+)'), F.lit(1))
    return F.coalesce(first(includes, SPF_PROVIDERS), first(F.transform(mx, F.lower), MX_PROVIDERS))


def pattern_hint(provider: Column) -> Column:
    """The pattern that a provider suggests; null for the others."""
    return F.element_at(F.create_map(*[x for k, v in PROVIDER_PATTERNS.items() for x in (F.lit(k), F.lit(v))]), provider)


def vendor_pattern(name: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in VENDOR_PATTERNS.items() for x in (F.lit(k), F.lit(v))]), name)


def fill_pattern(pattern: Column, first: Column, last: Column, domain: Column) -> Column:
    """The address that a pattern makes; null where a name part is missing."""
    out = pattern
    for hole, value in (("{first}", first), ("{last}", last), ("{f}", F.left(first, F.lit(1))), ("{domain}", domain)):
        out = F.replace(out, F.lit(hole), value)
    return F.when((first != "") & (last != ""), out)


def domain_emails(people: DataFrame, found: DataFrame, leftover: bool = False) -> DataFrame:
    """(domain, seq, email, how) from addresses seen for a domain: best match by name, each address
    once (J8); with `leftover` the rest in order (J9). `people`: (domain, seq, first, last); `found`: (domain, email, pos)."""
    named = people.select("domain", "first", "last").distinct().withColumn("seq", F.lit(0).cast("long"))
    score = t.email_name_score(F.col("email"), F.col("first"), F.col("last"))
    pairs = matching.name_pairs(named, found.select("domain", "email")).withColumn("score", score)
    best = matching.greedy_match(people, pairs, alike=["first", "last"])
    out = best.withColumn("how", F.lit("name"))
    if leftover:
        rest = people.join(best.select("domain", "seq"), ["domain", "seq"], "left_anti").select("domain", "seq")
        free = found.join(best.select("domain", "email"), ["domain", "email"], "left_anti").select("domain", "email", "pos")
        out = out.unionByName(matching.leftovers(rest, free).where("email is not null").withColumn("how", F.lit("order")))
    return out


def avatar_emails(people: DataFrame, hashes: DataFrame) -> DataFrame:
    """Each person's first candidate whose md5 is in `hashes` (digest)."""
    c = people.select("domain", "seq", F.posexplode(patterns.candidates(F.col("first"), F.col("last"), F.col("domain"))).alias("pos", "c"))
    c = c.withColumn("digest", F.md5(F.lower(F.trim("c.email")))).join(hashes.select("digest").distinct(), "digest", "left_semi")
    return c.groupBy("domain", "seq").agg(F.min_by("c.email", "pos").alias("email"))


def catch_all_emails(people: DataFrame, flags: DataFrame) -> DataFrame:
    """First.last of the names as written, in lower case, for people without address whose domain takes anything.
    `people`: (domain, seq, name, email); `flags`: (domain, catch_all)."""
    words = t.words(F.lower("name"))
    made = F.concat(F.get(words, F.lit(0)), F.when(F.size(words) > 1, F.concat(F.lit("."), F.element_at(words, -1))).otherwise(""), F.lit("@"), F.col("domain"))
    yes = flags.where("catch_all").select("domain").distinct()
    return people.where(F.col("email").isNull() & (F.size(words) > 0)).join(yes, "domain", "left_semi").select("domain", "seq", made.alias("email"), F.lit("catch_all_generated").alias("email_status"))


def vendor_contacts(people: DataFrame, contacts: DataFrame, domains: DataFrame) -> DataFrame:
    """Email and status of people (domain, seq, first, last, email, email_status): the vendor's contact of that
    first and last name at a confidence of 70 or more, the last one listed, else the domain's pattern unless the address
    was verified or scraped. `contacts`: (domain, first, last, email, confidence, pos); `domains`: (domain, pattern)."""
    sure = contacts.where((F.col("confidence") >= VENDOR_LEAST) & F.contains("email", F.lit("@")) & (F.coalesce("first", F.lit("")) != "") & (F.coalesce("last", F.lit("")) != ""))
    sure = sure.groupBy("domain", "first", "last").agg(F.max_by(F.lower("email"), "pos").alias("_exact"))
    known = domains.groupBy("domain").agg(vendor_pattern(F.max("pattern")).alias("_pattern"))
    made = fill_pattern(F.col("_pattern"), F.col("first"), F.col("last"), F.col("domain"))
    use = F.when(~F.coalesce(F.col("email_status"), F.lit("")).isin("verified", "scraped"), made)
    out = people.join(sure, ["domain", "first", "last"], "left").join(known, "domain", "left")
    status = F.when(F.col("_exact").isNotNull(), "verified").when(use.isNotNull(), "guessed").otherwise(F.col("email_status"))
    return out.select("domain", "seq", F.coalesce("_exact", use, "email").alias("email"), status.alias("email_status"))


def vendor_person(people: DataFrame, answers: DataFrame) -> DataFrame:
    """People (seq, email, email_status, role, linkedin) with a vendor's answer (seq, v_email, v_role, v_linkedin): the
    address only over none, or one that is unknown or guessed; the other fields where they are blank."""
    weak = F.col("email").isNull() | F.col("email_status").isin("unknown", "guessed")
    take = weak & F.col("v_email").isNotNull()
    out = people.join(answers, "seq", "left")
    return out.select("seq", F.when(take, F.col("v_email")).otherwise(F.col("email")).alias("email"), F.when(take, "verified").otherwise(F.col("email_status")).alias("email_status"), t.first_of(F.col("role"), F.col("v_role")).alias("role"), t.first_of(F.col("linkedin"), F.col("v_linkedin")).alias("linkedin"))


def discover_patterns(people: DataFrame, delivered: DataFrame, probes: int = 3) -> DataFrame:
    """(domain, pattern): of each domain's first person, the first of the first three candidates that was delivered.
    `delivered`: (email)."""
    one = people.groupBy("domain").agg(F.min_by(F.struct("first", "last"), "seq").alias("p"))
    c = one.select("domain", F.posexplode(F.slice(patterns.candidates(F.col("p.first"), F.col("p.last"), F.col("domain")), 1, probes)).alias("pos", "c"))
    c = c.select("domain", "pos", F.col("c.pattern").alias("pattern"), F.col("c.email").alias("email")).join(delivered.select("email").distinct(), "email", "left_semi")
    return c.groupBy("domain").agg(F.min_by("pattern", "pos").alias("pattern"))


def guess_batch(people: DataFrame, mx: DataFrame, order: list[str] = ("late", "seq"), blocks: int | None = None) -> DataFrame:
    """Addresses for people (domain, seq, first, last, email) without one, in order, by what was learned before.

    A person with an address is an observation of its pattern (A13). One without gets the domain's commonest pattern so far, the
    one seen first in a tie; if nothing was seen yet and the domain takes mail (mx: domain, has_mx), the commonest
    pattern of all, and that guess counts as an observation for later people of the domain. `late` is whether a person has no address,
    so by default all addresses are learned from before any is guessed; with order=["seq"] people are taken as they come.
    Returns (domain, seq, email, how): known, pattern, default or none.

    A default is guessed at most once a domain: its guess is the first thing seen. So all counts are running sums, one a pattern,
    over blocks of ordered rows; a domain of many people is no task's own.
    """
    gate = mx.groupBy("domain").agg(F.max("has_mx").alias("_mx"))
    rows = people.select("domain", "seq", "first", "last", "email").join(gate, "domain", "left")
    named = (F.coalesce("first", F.lit("")) != "") & (F.coalesce("last", F.lit("")) != "")
    rows = rows.withColumns({"late": F.col("email").isNull(), "_pattern": patterns.detect(F.col("email"), F.col("first"), F.col("last")), "_open": F.col("email").isNull() & named & F.coalesce("_mx", F.lit(False))})
    rows = prefix.ordered(rows, ["domain", *order, *[c for c in ("seq",) if c not in order]], blocks)
    rows = prefix.counts_before(rows, "domain", _seen=F.col("_pattern").isNotNull(), _asked=F.col("_open"))
    default = F.col("_open") & (F.col("_seen") == 0) & (F.col("_asked") == 0)
    rows = rows.withColumn("_default", default).withColumn("_saw", F.when(F.col("_default"), patterns.PATTERNS[0]).otherwise(F.col("_pattern")))
    kinds = {f"_n{i}": F.col("_saw") == p for i, p in enumerate(patterns.PATTERNS)}
    rows = prefix.counts_before(rows, "domain", **kinds)
    # Which of equally common ones was seen first: its first place in the domain.
    first = rows.where("_saw is not null").groupBy("domain", "_saw").agg(F.min(F.struct("_block", "_at")).alias("at"))
    first = first.groupBy(F.col("domain").alias("_d")).agg(F.map_from_entries(F.collect_list(F.struct("_saw", "at"))).alias("_firsts"))
    rows = rows.join(first, F.col("domain").eqNullSafe(F.col("_d")), "left")
    # Fewest first: the greatest count, then the earliest place, so both are negated or kept for one `least`.
    best = F.least(*[F.when(F.col(f"_n{i}") > 0, F.struct((-F.col(f"_n{i}")).alias("n"), F.col("_firsts")[p].alias("at"), F.lit(p).alias("p"))) for i, p in enumerate(patterns.PATTERNS)])["p"]
    made = lambda p: fill_pattern(p, F.col("first"), F.col("last"), F.col("domain"))
    rows = rows.withColumn("_best", best)
    guess = F.when(F.col("_default"), made(F.lit(patterns.PATTERNS[0]))).when(F.col("_best").isNotNull(), made(F.col("_best")))
    how = F.when(F.col("email").isNotNull(), "known").when(guess.isNull(), "none").when(F.col("_default"), "default").otherwise("pattern")
    return rows.select("domain", "seq", F.coalesce("email", guess).alias("email"), how.alias("how"))


def validated(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows with the validation result of their address; one result an address, rows without one keep null."""
    one = results.groupBy("email").agg(*[F.first(c).alias(c) for c in results.columns if c != "email"])
    return rows.join(one, "email", "left")
