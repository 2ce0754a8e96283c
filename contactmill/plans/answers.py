"""Lookups whose answers come in as tables, and what becomes of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import text as t_
from contactmill.operators import enrich, lookups, matching, patterns

from .base import Tables, query


def _k() -> Column:
    return F.col("c_custkey")


def _people(t: Tables) -> DataFrame:
    """Customers as people: a first name by the id's last digits, a last name of their own, a domain by nation."""
    first = F.element_at(F.array(*[F.lit(n) for n in ("ann", "bob", "cyd")]), (_k() % 3 + 1).cast("int"))
    return t.customer.select(F.concat(F.lit("n"), "c_nationkey", F.lit(".test")).alias("domain"), _k().alias("seq"), first.alias("first"), F.concat(F.lit("fox"), _letters(_k()), F.lit("z")).alias("last"))


def _letters(n):
    """A number spelt in letters."""
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


_PEOPLE = "p as (select 'n' || c_nationkey || '.test' as domain, c_custkey as seq, ['ann', 'bob', 'cyd'][c_custkey % 3 + 1] as first, 'fox' || translate(c_custkey::varchar, '0123456789', 'abcdefghij') || 'z' as last from customer)"


@query(f"with {_PEOPLE} select domain, seq, last || '@' || domain as email, 'name' as how from p where seq % 2 = 0")
def domain_emails(t: Tables) -> DataFrame:
    """Addresses that a lookup found for a domain, to people by name."""
    p = _people(t)
    found = p.where("seq % 2 = 0").select("domain", F.concat("last", F.lit("@"), "domain").alias("email"), F.col("seq").alias("pos"))
    return lookups.domain_emails(p, found.unionByName(found.select("domain", F.concat(F.lit("info@"), "domain").alias("email"), "pos").distinct()))


@query(f"""with {_PEOPLE}, f as (select domain, min(seq) as lo from p group by domain), r as (select p.domain, seq, row_number() over (partition by p.domain order by seq) as n from p join f using (domain) where seq <> lo),
m as (select p.domain, p.seq, last || '@' || p.domain as email, 'name' as how from p join f on p.domain = f.domain and p.seq = f.lo) select * from m union all select domain, seq, 'office' || n || '@' || domain, 'order' from r where n <= 2""")
def leftover_emails(t: Tables) -> DataFrame:
    """Then what is left of the addresses, in order, to the people that are left."""
    p = _people(t)
    lo = p.groupBy("domain").agg(F.min_by("last", "seq").alias("last"))
    found = lo.select("domain", F.concat("last", F.lit("@"), "domain").alias("email"), F.lit(1).alias("pos")).union(lo.select("domain", F.concat(F.lit("office1@"), "domain"), F.lit(2))).union(lo.select("domain", F.concat(F.lit("office2@"), "domain"), F.lit(3)))
    return lookups.domain_emails(p, found, leftover=True)


@query("select c_custkey as seq, case c_custkey % 4 when 0 then 'google_workspace' when 1 then 'microsoft_365' when 2 then 'protonmail' end as provider, case when c_custkey % 4 < 2 then '{first}.{last}@{domain}' when c_custkey % 4 = 2 then '{first}@{domain}' end as pattern from customer")
def provider_hints(t: Tables) -> DataFrame:
    """Mail providers by SPF, then MX, and the pattern that they suggest."""
    m = _k() % 4
    txt = F.when(m == 0, '"v=spf1 include:unknown.test include:_spf.Google.com ~all"').when(m == 1, "v=spf1 include:spf.protection.outlook.com -all")
    mx = F.when(m == 2, F.array(F.lit("mx.other.test"), F.lit("Mail.ProtonMail.ch"))).otherwise(F.array(F.lit("mx.own.test")))
    name = lookups.provider(txt, mx)
    return t.customer.select(_k().alias("seq"), name.alias("provider")).withColumn("pattern", lookups.pattern_hint(F.col("provider")))


@query(f"with {_PEOPLE} select domain, seq, case when seq % 3 = 0 then first || '.' || last else first[1] || last end || '@' || domain as email from p where seq % 3 <> 2")
def avatar_emails(t: Tables) -> DataFrame:
    """The first candidate with a known avatar."""
    p = _people(t)
    made = lambda *parts: F.md5(F.concat(*parts, F.lit("@"), "domain"))
    seen = p.where("seq % 3 = 0").select(F.explode(F.array(made("first", F.lit("."), "last"), made("last"))).alias("digest")).union(p.where("seq % 3 = 1").select(made(F.left("first", F.lit(1)), "last")))
    return lookups.avatar_emails(p, seen)


@query("select 'n' || c_nationkey || '.test' as domain, c_custkey as seq, case when c_custkey % 5 = 0 then 'solo' else 'ána.o''fox' end || '@n' || c_nationkey || '.test' as email, 'catch_all_generated' as email_status from customer where c_custkey % 2 = 0 and c_nationkey < 10")
def catch_all_emails(t: Tables) -> DataFrame:
    """Names as written for domains that take anything."""
    domain = F.concat(F.lit("n"), "c_nationkey", F.lit(".test"))
    p = t.customer.select(domain.alias("domain"), _k().alias("seq"), F.when(_k() % 5 == 0, " Solo ").otherwise("Ána  de O'Fox").alias("name"), F.when(_k() % 2 == 1, "known@x.test").alias("email"))
    return lookups.catch_all_emails(p, t.nation.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".test")).alias("domain"), (F.col("n_nationkey") < 10).alias("catch_all")))


@query(f"""with {_PEOPLE} select domain, seq, case when seq % 4 = 0 then 'v' || seq || '@' || domain when split_part(domain, '.', 1) in ('n1', 'n2') and seq % 4 <> 1 then first[1] || '.' || last || '@' || domain when seq % 4 = 1 then 'own@x.test' end as email,
case when seq % 4 = 0 then 'verified' when seq % 4 = 1 then 'scraped' when split_part(domain, '.', 1) in ('n1', 'n2') then 'guessed' else 'unknown' end as email_status from p""")
def vendor_contacts(t: Tables) -> DataFrame:
    """A vendor's contacts at a confidence of 70 or more, else the domain's pattern."""
    p = _people(t)
    contacts = p.where("seq % 4 in (0, 2)").select("domain", "first", "last", F.concat(F.lit("V"), "seq", F.lit("@"), "domain").alias("email"), F.when(F.col("seq") % 4 == 0, 70).otherwise(69).alias("confidence"), F.col("seq").alias("pos"))
    domains = t.spark.createDataFrame([("n1.test", "f.last"), ("n2.test", "f.last"), ("n3.test", "odd")], "domain string, pattern string")
    rows = p.withColumns({"email": F.when(F.col("seq") % 4 == 1, "own@x.test"), "email_status": F.when(F.col("seq") % 4 == 1, "scraped").otherwise("unknown")})
    return lookups.vendor_contacts(rows, contacts, domains)


@query("select c_custkey as seq, case c_custkey % 4 when 0 then 'v@x.test' when 1 then 'own@x.test' when 2 then 'v@x.test' else 'own@x.test' end as email, case c_custkey % 4 when 1 then 'scraped' when 3 then 'guessed' else 'verified' end as email_status, case when c_custkey % 4 = 3 then null else 'Partner' end as role from customer")
def vendor_person(t: Tables) -> DataFrame:
    """A vendor's answer for a person over no address, or one that was guessed; none for every fourth."""
    m = _k() % 4
    rows = t.customer.select(_k().alias("seq"), F.when(m != 0, "own@x.test").alias("email"), F.when(m == 1, "scraped").otherwise("guessed").alias("email_status"), F.lit("N/A").alias("role"), F.lit("").alias("linkedin"))
    answers = t.customer.where("c_custkey % 4 <> 3").select(_k().alias("seq"), F.lit("v@x.test").alias("v_email"), F.lit("Partner").alias("v_role"), F.lit(None).cast("string").alias("v_linkedin"))
    return lookups.vendor_person(rows, answers).drop("linkedin")


@query(f"with {_PEOPLE}, o as (select domain, min(seq) as seq from p group by domain) select domain, case when seq % 2 = 0 then '{{first}}@{{domain}}' else '{{f}}{{last}}@{{domain}}' end as pattern from o where seq % 5 <> 0")
def discovered_patterns(t: Tables) -> DataFrame:
    """The first of three probed candidates that was delivered, of each domain's first person."""
    p = _people(t)
    one = p.groupBy("domain").agg(F.min_by(F.struct("first", "last", "seq"), "seq").alias("p")).select("domain", "p.*")
    mail = F.when(F.col("seq") % 2 == 0, F.array("first", F.concat(F.left("first", F.lit(1)), "last"))).otherwise(F.array(F.concat(F.left("first", F.lit(1)), "last"), F.col("last")))
    delivered = one.where("seq % 5 <> 0").select("domain", F.explode(mail).alias("local")).select(F.concat("local", F.lit("@"), "domain").alias("email"))
    return lookups.discover_patterns(p, delivered)


# Each person's address if known, as the shape that it has, in the order in which people are taken.
_TAKEN = """x as (select p.*, split_part(domain, '.', 1)[2:]::bigint as n, case when seq % 7 = 0 and seq % 2 = 0 then '{last}@{domain}' when seq % 7 = 0 then '{first}@{domain}' end as shape from p),
y as (select *, case when n % 3 = 0 or shape is null then shape end as known from x),
f as (select domain, min(seq) filter (where known is not null) as seen, min(seq) filter (where known is null and n % 3 <> 2) as asked from y group by domain),
o as (select y.*, known is null and n % 3 <> 2 and y.seq = f.asked and coalesce(f.seen > f.asked, true) as fresh from y join f using (domain)),
s as (select *, case when fresh then '{first}.{last}@{domain}' else known end as saw from o),
c as (select a.domain, a.seq, b.saw, count(*) as k, min(b.seq) as early from s a join s b on a.domain = b.domain and b.seq < a.seq where b.saw is not null group by all),
w as (select domain, seq, arg_min(saw, (-k, early)) as best from c group by all),
z as (select s.*, case when fresh then '{first}.{last}@{domain}' else best end as use from s left join w using (domain, seq))
select domain, seq, case when known is not null then case known when '{last}@{domain}' then last else first end || '@' || domain when use is not null then replace(replace(replace(use, '{first}', first), '{last}', last), '{domain}', domain) end as email,
case when known is not null then 'known' when fresh then 'default' when use is not null then 'pattern' else 'none' end as how from z"""


@query(f"with {_PEOPLE}, {_TAKEN}")
def guess_batch(t: Tables) -> DataFrame:
    """People as they come; what was seen or guessed before them tells the pattern. Each third domain has addresses, the next only takes mail."""
    p = _people(t).withColumn("n", F.substring_index(F.substring("domain", 2, 9), ".", 1).cast("long"))
    own = F.when(F.col("seq") % 7 == 0, F.concat(F.when(F.col("seq") % 2 == 0, F.col("last")).otherwise(F.col("first")), F.lit("@"), "domain"))
    rows = p.withColumn("email", F.when(F.col("n") % 3 == 0, own))
    gate = t.nation.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".test")).alias("domain"), (F.col("n_nationkey") % 3 != 2).alias("has_mx"))
    return lookups.guess_batch(rows, gate, order=["seq"])


@query("select domain, pattern, best, total from (values ('a.test', '{last}@{domain}', 5, 9), ('b.test', '{first}@{domain}', 2, 2)) as v(domain, pattern, best, total)")
def weighted_patterns(t: Tables) -> DataFrame:
    """A vendor's word counts five observations, a mail provider's two."""
    rows = [("a.test", "{last}@{domain}", lookups.VENDOR_WEIGHT, 1), ("a.test", "{first}@{domain}", lookups.DNS_WEIGHT, 2), ("a.test", "{first}@{domain}", lookups.DNS_WEIGHT, 3), ("b.test", "{first}@{domain}", lookups.DNS_WEIGHT, 4)]
    return patterns.learn(t.spark.createDataFrame(rows, "domain string, pattern string, w long, seq long"), "w")


@query("select c_custkey, case when c_custkey % 2 = 0 then 'ok' end as quality from customer")
def validation_join(t: Tables) -> DataFrame:
    """The validation result of each address, stored more than once."""
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit("@x.test")).alias("email"))
    results = rows.where("c_custkey % 2 = 0").select("email", F.lit("ok").alias("quality"))
    return lookups.validated(rows, results.union(results)).select("c_custkey", "quality")


@query("select c_custkey, case c_custkey % 5 when 0 then 'unknown' when 1 then 'scraped' when 2 then 'verified' when 3 then 'guessed' else 'catch_all' end as status from customer")
def derived_status(t: Tables) -> DataFrame:
    """An unknown status from what else is known."""
    m = _k() % 5
    got = t_.derived_status(F.when(m == 4, "catch_all").otherwise("unknown"), F.when(m == 0, "N/A").otherwise("a@x.test"), m.isin(1, 2), F.when(m == 1, "scraped").when(m == 3, "pattern"))
    return t.customer.select("c_custkey", got.alias("status"))


@query("select c_custkey from customer where c_custkey % 4 <> 0")
def person_rows(t: Tables) -> DataFrame:
    """Rows whose name isn't their fund's."""
    fund = F.when(_k() % 4 == 0, F.concat(F.lit(" "), F.upper("c_name"))).otherwise("Fund")
    return t.customer.where(t_.not_fund_row(F.col("c_name"), fund)).select("c_custkey")


@query(f"with {_PEOPLE} select seq as page_id, first || ' ' || last as name, 'https://www.linkedin.com/in/' || first || last || '-1' as url from p")
def profile_links_of_people(t: Tables) -> DataFrame:
    """The first profile link of a page that holds the first six letters of the squashed name."""
    p = _people(t).select(F.col("seq").alias("page_id"), F.concat_ws(" ", "first", "last").alias("name"), F.concat("first", "last").alias("squashed"))
    url = lambda end: F.concat(F.lit("https://www.linkedin.com/in/"), end)
    urls = p.select("page_id", F.posexplode(F.array(url(F.lit("zed")), url(F.concat("squashed", F.lit("-1"))), url(F.concat("squashed", F.lit("-2"))))).alias("pos", "url"))
    return matching.url_for_name(p.select("page_id", "name"), urls)


@query(f"with {_PEOPLE} select seq as page_id, first || ' ' || last as name, 'https://' || domain || case seq % 3 when 0 then '/x/1' when 1 then '/people/' || first || '-' || last else '/t/' || first || last end as url from p")
def bio_links(t: Tables) -> DataFrame:
    """A person's page by link text, else by a path with the name dashed or squashed; the same host only."""
    p = _people(t).select(F.col("seq").alias("page_id"), F.concat_ws(" ", "first", "last").alias("name"), F.col("domain").alias("host"), "first", "last")
    m = F.col("page_id") % 3
    base = F.concat(F.lit("https://"), "host")
    good = F.struct(F.lit(2).alias("pos"), F.concat(base, F.when(m == 0, "/x/1").when(m == 1, F.concat(F.lit("/people/"), "first", F.lit("-"), "last")).otherwise(F.concat(F.lit("/t/"), "first", "last"))).alias("url"), F.when(m == 0, F.concat(F.lit("Meet "), F.initcap("name"))).otherwise("more").alias("label"))
    away = F.struct(F.lit(1).alias("pos"), F.concat(F.lit("https://other.test/"), "first", "last").alias("url"), F.col("name").alias("label"))
    none = F.struct(F.lit(0).alias("pos"), F.concat(base, F.lit("/about")).alias("url"), F.lit("About").alias("label"))
    links = p.select("page_id", F.explode(F.array(none, away, good)).alias("x")).select("page_id", "x.*")
    return matching.link_for_name(p.select("page_id", "name", "host"), links)


@query("select c_nationkey as nation, c_mktsegment as seg, max_by(c_name, c_custkey) as last_name, max(c_custkey) as last_key from customer group by all")
def scraped_index(t: Tables) -> DataFrame:
    """The last row of each key wins."""
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), F.col("c_name").alias("last_name"), _k().alias("last_key"))
    return matching.last_by_key(rows, ["nation", "seg"], "last_key", "last_name", "last_key")


@query(f"with {_PEOPLE} select seq, first || ' ' || last as name, domain, case when seq % 3 = 0 then 'b@' || domain else 'a' || seq || '@other.test' end as email from p where seq % 3 <> 2")
def keyserver_emails(t: Tables) -> DataFrame:
    """Of a name's addresses the first on the own domain, else the first."""
    p = _people(t).select("seq", F.concat_ws(" ", "first", "last").alias("name"), "domain")
    own = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("b@"), F.upper("domain"))).otherwise("z@third.test")
    found = p.where("seq % 3 <> 2").select("name", F.posexplode(F.array(F.concat(F.lit("a"), "seq", F.lit("@other.test")), own)).alias("pos", "email"))
    return matching.prefer_domain(p, found).withColumn("email", F.lower("email"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'Partner' else 'Own' end as role, case when c_custkey % 3 = 0 then 'Oslo' end as location from customer")
def profile_fill(t: Tables) -> DataFrame:
    """Role and place of a profile where they are missing."""
    rows = t.customer.select("c_custkey", F.concat(F.lit("in/"), _k()).alias("linkedin"), F.when(_k() % 2 == 1, "Own").alias("role"), F.lit(None).cast("string").alias("location"))
    facts = rows.select("linkedin", F.lit("Partner").alias("role"), F.when(_k() % 3 == 0, "Oslo").alias("location"))
    return enrich.fill_from(rows, facts, ["linkedin"], ["role", "location"]).select("c_custkey", "role", "location")


@query(f"with {_PEOPLE} select * from (select domain, seq, first || '.' || last || '@' || domain as email from p where seq % 3 = 0) order by md5('42|' || email), email limit 50")
def verify_sample(t: Tables) -> DataFrame:
    """Each person's best candidate, of one tier, and a seeded sample of fifty to be verified."""
    p = _people(t).withColumn("tier", F.when(F.col("seq") % 3 == 0, "HIGH").otherwise("LOW"))
    c = p.select("domain", "seq", "tier", F.posexplode(patterns.candidates(F.col("first"), F.col("last"), F.col("domain"))).alias("pos", "c"))
    best = patterns.top(c.select("domain", "seq", "tier", "c.pattern", "c.email", (0.9 - F.col("pos") / 10).alias("score")), ["seq"], 1)
    return patterns.sample(best.where("tier = 'HIGH'"), 50, 42).select("domain", "seq", "email")
