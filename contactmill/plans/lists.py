"""Lists, filings, cards and stored tables as leads, and what is written for other tools. Texts are built from the tables,
so that every answer is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import text as t_
from contactmill.operators import analytics, dedupe, prefix
from contactmill.session import new_folder
from contactmill.sources import formats, readers, sinks
from contactmill.streaming import streams

from .base import Tables, query


def _n() -> Column:
    return F.col("s_suppkey")


@query("select s_name as name, case when s_suppkey % 2 = 0 then 'https://' else 'http://' end || 's' || s_suppkey || '.test' as website, 'N' || s_nationkey as location, 'a,' || s_suppkey as areas from supplier")
def fuzzy_header_csv(t: Tables) -> DataFrame:
    """A table whose headers only resemble the fields; bare sites get a scheme."""
    site = F.concat(F.when(_n() % 2 == 0, "").otherwise("http://"), F.lit("s"), _n(), F.lit(".test"))
    odd = t.supplier.select(F.concat(F.lit(" "), "s_name").alias("Firm Name"), site.alias("Web Site"), F.concat(F.lit("N"), "s_nationkey").alias("HQ City"), F.concat(F.lit("a | "), _n()).alias("Sector Focus"))
    short = odd.limit(1).withColumn("Firm Name", F.lit("x"))
    return readers.fuzzy_csv(odd.union(short)).select("name", "website", "location", F.array_join("focus_areas", ",").alias("areas"))


@query("select s_suppkey, s_name as name, 'https://s' || s_suppkey || '.test/' as website from supplier union all select s_suppkey, 'Second one', 'http://second.test' from supplier")
def markdown_links(t: Tables) -> DataFrame:
    """Links of a text; short names, badges and code hosting left out."""
    text = F.concat(F.lit("See ["), "s_name", F.lit("](https://s"), _n(), F.lit(".test/) and [ab](https://short.test), [Build](https://badge.test/x) [Code](https://github.com/x) [Second one](http://second.test)"))
    return readers.markdown_links(t.supplier.select("s_suppkey", text.alias("text")), "text")


@query("select s_suppkey, 'Ann ' || s_suppkey as name, s_name as fund, 'Chief of ' || s_nationkey as role from supplier union all select s_suppkey, 'Bob Li', s_name, 'Director, Promoter' from supplier union all select s_suppkey, 'Cy', s_name, 'Principal' from supplier")
def form_d_officers(t: Tables) -> DataFrame:
    """People of filings with namespaces; clarification before relationship before Principal; investors left out."""
    person = lambda first, last, roles, more: F.concat(F.lit(f"<n:relatedPersonInfo><n:relatedPersonName><n:firstName>{first}</n:firstName>"), F.concat(F.lit("<n:lastName>"), last, F.lit("</n:lastName>")) if last is not None else F.lit(""), F.lit("</n:relatedPersonName><n:relatedPersonRelationshipList>" + "".join(f"<n:relationship>{r}</n:relationship>" for r in roles) + "</n:relatedPersonRelationshipList>"), more, F.lit("</n:relatedPersonInfo>"))
    note = F.concat(F.lit("<n:relationshipClarification>Chief of "), "s_nationkey", F.lit("</n:relationshipClarification>"))
    people = F.concat(person("Ann", _n(), ["Director"], note), person("Bob", F.lit("Li"), ["Director", "Promoter"], F.lit("")), person("Cy", None, [], F.lit("")), person("Di", F.lit("Fo"), ["Investor"], F.lit("")))
    xml = F.concat(F.lit('<n:edgarSubmission xmlns:n="http://n.test"><n:primaryIssuer><n:entityName>'), "s_name", F.lit("</n:entityName></n:primaryIssuer><n:relatedPersonsList>"), people, F.lit("</n:relatedPersonsList></n:edgarSubmission>"))
    return readers.form_d_people(t.supplier.select("s_suppkey", xml.alias("xml")), "xml")


@query("select s_suppkey, pos::bigint as pos, case pos when 0 then 'Ann Lee' when 2 then 'Bob van Dyk' else 'Cy Fox' end as name, case pos when 0 then 'Managing Director' when 2 then 'Analyst ' || s_nationkey else 'Principal' end as role from supplier, (select unnest([0, 2, 5]) as pos) where pos <> 2")
def person_lines(t: Tables) -> DataFrame:
    """Lines of capitalised words with the next role line, else the default."""
    text = F.concat(F.lit("Ann Lee\nManaging Director\nBob van Dyk\nAnalyst "), "s_nationkey", F.lit("\n12 High St\nCy Fox\nmore\ntext\nhere\nOfficer of none"))
    return readers.people_lines(t.supplier.select("s_suppkey", text.alias("text")), "text", "s_suppkey", default="Principal")


@query("select company, filed, cik, file from (select s_name as company, '2001-0' || (s_suppkey % 9 + 1) || '-15' as filed, s_suppkey::varchar as cik, 'f/' || s_suppkey || '.txt' as file from supplier) order by filed desc, cik, file limit 20")
def newest_filings(t: Tables) -> DataFrame:
    """The twenty newest filings."""
    line = F.concat(F.rpad("s_name", 62, " "), F.lit("D/A   "), F.lpad(_n().cast("string"), 8, "0"), F.lit("  2001-0"), _n() % 9 + 1, F.lit("-15  f/"), _n(), F.lit(".txt"))
    return readers.newest(readers.company_index(t.supplier.select(line.alias("value"))), 20).select("company", F.col("filed").cast("string").alias("filed"), "cik", "file")


def _index_files(t: Tables) -> str:
    """A folder of filing indexes, one file a part of the suppliers."""
    folder = new_folder(t.spark, "filings")
    line = F.concat(F.rpad("s_name", 62, " "), F.when(_n() % 3 == 2, "10-K").otherwise("D/A"), F.lit("   "), F.lpad(_n().cast("string"), 8, "0"), F.lit("  2001-0"), _n() % 9 + 1, F.lit("-15  f/"), _n(), F.lit(".txt"))
    t.supplier.select(line.alias("value")).repartition(3).write.text(folder)
    return folder


@query("select s_suppkey::varchar as cik, s_name as company from supplier where s_suppkey % 3 <> 2")
def filing_source(t: Tables) -> DataFrame:
    """Filing indexes by format name, two of their columns."""
    formats.register(t.spark)
    return t.spark.read.format("filing_index").schema("cik string, company string").option("path", _index_files(t)).load()


@query("select s_name as company, 'D/A' as form, s_suppkey::varchar as cik, '2001-0' || (s_suppkey % 9 + 1) || '-15' as filed, 'f/' || s_suppkey || '.txt' as file from supplier where s_suppkey % 3 <> 2")
def filing_stream(t: Tables) -> DataFrame:
    """Filing indexes as a stream, which is started again when more files have come."""
    formats.register(t.spark)
    path, out = _index_files(t), new_folder(t.spark, "filing-stream")
    for _ in range(2):
        streams.run_once(t.spark.readStream.format("filing_index").option("path", path).load(), out)
    return t.spark.read.parquet(f"{out}/out").withColumn("filed", F.col("filed").cast("string"))


@query("select s_name as name, case when s_suppkey % 2 = 0 then 'Partner' end as role, 'N' || s_nationkey as location, 'openvc' as source from supplier where s_suppkey % 5 <> 0")
def card_source(t: Tables) -> DataFrame:
    """Cards by format name and adapter."""
    formats.register(t.spark)
    folder = new_folder(t.spark, "cards")
    name = F.when(_n() % 5 == 0, " ").otherwise(F.col("s_name"))
    card = F.struct(F.lit(" ").alias("name"), name.alias("title"), F.when(_n() % 2 == 0, "Partner").otherwise("N/A").alias("position"), F.concat(F.lit("N"), "s_nationkey").alias("city"))
    t.supplier.select(F.to_json(card).alias("value")).repartition(3).write.text(folder)
    return t.spark.read.format("adapter_cards").schema("name string, role string, location string, source string").option("path", folder).option("adapter", "openvc").load()


@query("select s_name as name, case when s_suppkey % 2 = 0 then 'Partner' end as role, 'N' || s_nationkey as location, 'openvc' as source from supplier where s_suppkey % 5 <> 0")
def adapter_cards(t: Tables) -> DataFrame:
    """Cards by an adapter of the registry: the first selector that isn't blank; cards without name left out."""
    name = F.when(_n() % 5 == 0, " ").otherwise(F.col("s_name"))
    card = F.create_map(F.lit("name"), F.lit(" "), F.lit("title"), name, F.lit("position"), F.when(_n() % 2 == 0, "Partner").otherwise("N/A"), F.lit("city"), F.concat(F.lit("N"), "s_nationkey"))
    assert "openvc" in readers.adapters.names("vc") and "openvc" not in readers.adapters.names("pe")
    return readers.adapters.leads(t.supplier.select(card.alias("card")), "openvc").select("name", "role", "location", "source")


@query("select s_name as name, null::varchar as email, case when s_suppkey % 2 = 0 then 'verified' else 'unknown' end as email_status, case when s_suppkey % 3 = 0 then 0 else s_suppkey end as lead_score, case when s_suppkey % 2 = 0 then '2001-02-03 04:05:06' end as scraped_at, 'a,b' as areas from supplier")
def stored_leads(t: Tables) -> DataFrame:
    """A stored table as leads: blanks null, unknown status, score 0, bad times null, areas by semicolon."""
    rows = t.supplier.select(F.col("s_name").alias("Name"), F.lit("N/A").alias("Email"), F.when(_n() % 2 == 0, "verified").otherwise("").alias("Email Status"), F.when(_n() % 3 == 0, "none").otherwise(_n().cast("string")).alias("Lead Score"), F.when(_n() % 2 == 0, "2001-02-03T04:05:06").otherwise("yesterday").alias("Scraped At"), F.lit("a; b;").alias("Focus Areas"))
    return readers.checkpoint(rows).select("name", "email", "email_status", "lead_score", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"), F.array_join("focus_areas", ",").alias("areas"))


@query("select event_id from events where ts > timestamp '2024-01-30' - interval 7 days")
def cached_entries(t: Tables) -> DataFrame:
    """Entries of a side table within seven days."""
    return readers.cached(t.events, "ts", "2024-01-30").select("event_id")


@query("select s_suppkey, 'Blue ' || s_nationkey || ' Capital' as manager, s_suppkey % 3 <> 0 as is_manager from supplier")
def pension_managers(t: Tables) -> DataFrame:
    """Managers of a disclosure table, without number and legal form."""
    raw = F.concat(F.lit("Blue "), "s_nationkey", F.lit(" Capital"), F.when(_n() % 2 == 0, " L.P.").otherwise(" LLC IV"))
    label = F.when(_n() % 3 == 0, "City Retirement System").otherwise(raw)
    return t.supplier.select("s_suppkey", t_.manager_name(raw).alias("manager"), t_.is_manager_name(label).alias("is_manager"))


@query("select s_suppkey, s_suppkey % 3 <> 2 as investor, case when s_suppkey % 2 = 0 then 'Blue Sky Ventures' end as fund, s_suppkey % 2 = 0 or s_suppkey % 3 = 0 as bio from supplier")
def speakers_and_bios(t: Tables) -> DataFrame:
    """Speakers who invest, and the fund that a bio names."""
    m = _n() % 3
    role, company = F.when(m == 0, "General Partner").otherwise("Engineer"), F.when(m == 1, "Blue Growth").otherwise("Blue Bakery")
    bio = F.when(_n() % 2 == 0, "Anna is a partner at Blue Sky Ventures and cooks.").when(m == 0, "Angel from Oslo").otherwise("Cooks")
    return t.supplier.select("s_suppkey", t_.is_investor_speaker(role, company).alias("investor"), t_.bio_fund(bio).alias("fund"), t_.any_part(bio, t_.BIO_WORDS).alias("bio"))


@query("select s_suppkey, array_to_string(case s_suppkey % 3 when 0 then ['Blue Sky Ventures', 'Red Rock Capital'] when 1 then ['Green Fund'] else [] end, ';') as funds from supplier")
def announced_investors(t: Tables) -> DataFrame:
    """Funds that an announcement names."""
    m = _n() % 3
    text = F.when(m == 0, "A round led by Blue Sky Ventures and Red Rock Capital").when(m == 1, "it was backed by Green Fund last year").otherwise("no names")
    return t.supplier.select("s_suppkey", F.array_join(t_.led_by(text), ";").alias("funds"))


def _leads(t: Tables) -> DataFrame:
    key, score = F.col("c_custkey"), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100)).cast("int")
    tier = F.when(score >= 80, "HOT").when(score >= 60, "WARM").when(score >= 40, "COOL").otherwise("COLD")
    return t.customer.select(F.col("c_name").alias("name"), F.when(key % 3 != 0, F.concat(F.lit("c"), key, F.lit("@x.test"))).alias("email"), F.concat(F.lit("F"), "c_nationkey").alias("fund"), F.array(F.col("c_mktsegment"), F.lit("b")).alias("focus_areas"), score.alias("lead_score"), tier.alias("tier"), F.when(key % 2 == 0, "x").alias("thesis"), F.lit(None).cast("string").alias("board"))


_LEADS = """leads as (select *, case when lead_score >= 80 then 'HOT' when lead_score >= 60 then 'WARM' when lead_score >= 40 then 'COOL' else 'COLD' end as tier from (
select c_custkey, c_name as name, case when c_custkey % 3 <> 0 then 'c' || c_custkey || '@x.test' end as email, 'F' || c_nationkey as fund, c_mktsegment, greatest(0, floor(c_acctbal / 100))::bigint as lead_score from customer))"""


@query(f"""with {_LEADS} select name as "Name", coalesce(email, 'N/A') as "Email", fund as "Fund", c_mktsegment || '; b' as "Focus Areas", lead_score::varchar as "Lead Score", tier, case when c_custkey % 2 = 0 then 'x' else 'N/A' end as thesis from leads""")
def contact_table(t: Tables) -> DataFrame:
    """K1, K5: the contact table, written as CSV and read again; extra columns only if some row has one."""
    folder = new_folder(t.spark, "contacts")
    sinks.write_csv(_leads(t), folder, ["thesis", "board"])
    got = t.spark.read.csv(folder, header=True)
    assert "board" not in got.columns
    return got.withColumn("Tier", F.upper(F.regexp_extract("Tier", r"([A-Za-z]+)\s*$", 1))).withColumnRenamed("Tier", "tier")


@query("""with r as (select c_name, c_nationkey, 0 as src, c_acctbal as score from customer where c_custkey % 2 = 0 union all select c_name, c_nationkey, 1, c_acctbal + 1 from customer)
select c_name, c_nationkey, score from (select *, row_number() over (partition by c_name, c_nationkey order by src, score desc) as n from r) where n = 1""")
def master_merge(t: Tables) -> DataFrame:
    """K2: a master table and new rows, its own first."""
    rows = t.customer.select("c_name", "c_nationkey", F.col("c_acctbal").alias("score"), "c_custkey")
    new = rows.withColumn("score", F.col("score") + 1).drop("c_custkey")
    return dedupe.merge_write(rows.where("c_custkey % 2 = 0").drop("c_custkey"), new, ["c_name", "c_nationkey"], "score")


@query("select event_type, count(*) as n from events group by event_type")
def phase_checkpoint(t: Tables) -> DataFrame:
    """K6: the rows after a phase, stored and read again."""
    return sinks.write_checkpoint(t.events.select("event_type"), new_folder(t.spark, "phases"), "crawl").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select 'r' || user_id % 5 as run_id, event_type as stage, round(sum(value), 2) as duration_s, count(*) as lead_count, count(*) filter (where event_type = 'error') as error_count from events group by all)
select * from s union all select run_id, 'total', round(sum(duration_s), 2), max(lead_count), sum(error_count)::bigint from s group by run_id""")
def metrics_append(t: Tables) -> DataFrame:
    """K7, A10: stage rows and each run's total, appended to what is there."""
    path = new_folder(t.spark, "metrics")
    rows = t.events.groupBy(F.concat(F.lit("r"), F.col("user_id") % 5).alias("run_id"), F.col("event_type").alias("stage")).agg(F.max("ts").alias("timestamp"), F.round(F.sum("value"), 2).alias("duration_s"), F.count(F.lit(1)).alias("lead_count"), F.count_if(F.col("event_type") == "error").alias("error_count"))
    for part in (rows.where("run_id < 'r2'"), rows.where("run_id >= 'r2'")):
        sinks.append_metrics(part, path)
    return t.spark.read.parquet(path).drop("timestamp")


@query("""with s as (select 'r' || user_id % 5 as run_id, event_type, count(*) as n from events group by all) select run_id, max(n) as lead_count, sum(n) filter (where event_type = 'error')::bigint as error_count from s group by run_id""")
def run_totals(t: Tables) -> DataFrame:
    """A10: each run's greatest lead count and its errors."""
    n = F.count(F.lit(1))
    rows = t.events.groupBy(F.concat(F.lit("r"), F.col("user_id") % 5).alias("run_id"), "event_type").agg(n.alias("lead_count"), F.when(F.first("event_type") == "error", n).alias("error_count"))
    return analytics.run_totals(rows)


@query(f"with {_LEADS} select fund, name, lead_score, ((row_number() over (order by lead_score desc, name, fund) - 1) // 5)::bigint as batch from leads where lead_score >= 80")
def hot_messages(t: Tables) -> DataFrame:
    """K9: all hot leads in messages of five."""
    return sinks.hot_messages(_leads(t)).select("fund", "name", "lead_score", "batch")


@query(f"""with {_LEADS} select fund as company, email as "Email", ((row_number() over (order by email) - 1) // 100)::bigint as batch from leads where email is not null""")
def crm_batches(t: Tables) -> DataFrame:
    """Fields renamed for the receiver, all rows in numbered batches."""
    rows = _leads(t).where("email is not null").select("fund", "email")
    return sinks.upload_batches(rows, ["email"], rename={"fund": "company"}).withColumnRenamed("email", "Email")


@query(f"""with {_LEADS} select name as "Name", email as "Email", lead_score::varchar as "Lead Score", (((row_number() over (order by lead_score desc, name) - 1) // 1000)::bigint)::varchar as page from leads where lead_score >= 20 and email is not null and c_mktsegment <> 'MACHINERY'""")
def paged_export(t: Tables) -> DataFrame:
    """K5: filtered contacts as CSV in pages of a thousand, best first, read again."""
    path = new_folder(t.spark, "pages")
    rows = _leads(t).where(~F.array_contains("focus_areas", "MACHINERY"))
    sinks.write_pages(rows, path, [F.desc("lead_score"), "name"], min_score=20, score="lead_score", has_email=True)
    return t.spark.read.csv(path, header=True).select("Name", "Email", "Lead Score", "page")


@query("select o_orderkey, o_totalprice, ((row_number() over (order by o_totalprice desc, o_orderkey) - 1) // 5000)::bigint as batch from orders")
def global_batches(t: Tables) -> DataFrame:
    """Batches of five thousand over all rows, in one order."""
    return prefix.chunks(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 5000)


@query("select 'weights: ' || count(*) || chr(10) as text from customer")
def stored_config(t: Tables) -> DataFrame:
    """A configuration that replaces another one, read again."""
    path = f"{new_folder(t.spark, 'config')}/config.yaml"
    for n in (0, t.customer.count()):
        sinks.write_config(t.spark, f"weights: {n}\n", path)
    return t.spark.createDataFrame([(sinks.read_config(t.spark, path),)], "text string")


@query("select min(url) as value from pages where nullif(regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)', 1)), '^www\\.', ''), '') is not null group by nullif(regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)', 1)), '^www\\.', ''), '')")
def target_write(t: Tables) -> DataFrame:
    """One address of each host, written as text and read again."""
    path = new_folder(t.spark, "targets")
    sinks.write_targets(t.pages.select("url", t_.host(F.col("url")).alias("domain")).where("domain is not null"), path)
    return t.spark.read.text(path)


@query("select c_name as company, 'F' || c_nationkey as fund from customer where c_custkey % 4 <> 0")
def insert_if_absent(t: Tables) -> DataFrame:
    """Portfolio companies that aren't stored for their fund yet, the first of each."""
    rows = t.customer.select(F.col("c_name").alias("company"), F.concat(F.lit("F"), "c_nationkey").alias("fund"), "c_custkey")
    return dedupe.only_new(rows.union(rows), rows.where("c_custkey % 4 = 0"), ["fund", "company"], "c_custkey").select("company", "fund")


@query("select fund, domain from (select 'Name' || n_nationkey || 'Corp' as fund, n_nationkey, case n_nationkey % 3 when 0 then '.com' when 1 then '.vc' end as e, 'name' || n_nationkey || 'corp' || e as domain from nation) where e is not null")
def verified_domains(t: Tables) -> DataFrame:
    """Of each fund's candidate domains the first that exists."""
    n = F.col("n_nationkey")
    fund = F.concat(F.lit("Name"), n, F.lit("Corp"))
    exists = t.nation.select(F.explode(F.when(n % 3 == 0, F.array(F.lit(".com"), F.lit(".io"))).when(n % 3 == 1, F.array(F.lit(".fund"), F.lit(".vc"))).otherwise(F.array(F.lit(".test")))).alias("e"), F.lower(fund).alias("f")).select(F.concat("f", "e").alias("domain"))
    return readers.first_existing(t.nation.select(fund.alias("fund")), exists)


@query("select distinct 'd' || (s_suppkey % 60) || '.test' as domain from supplier where s_suppkey % 60 >= 10 union select 'c' || (c_nationkey) || '.test' from customer")
def domain_pool(t: Tables) -> DataFrame:
    """The domains of all lists that aren't known."""
    s = t.supplier.select(F.concat(F.lit("d"), _n() % 60, F.lit(".test")).alias("domain"))
    c = t.customer.select(F.concat(F.lit("c"), "c_nationkey", F.lit(".test")).alias("domain"))
    return readers.expand_domains([s, c, s], t.supplier.where("s_suppkey % 60 < 10").select(F.concat(F.lit("d"), _n() % 60, F.lit(".test")).alias("domain")))


@query("select lower(s_name) as name, any_value(website) as website, min(src) as source from (select s_name, 's' || s_suppkey || '.test' as website, 'seed:a' as src from supplier union all select s_name, 't.test', 'seed:b' from supplier where s_suppkey % 2 = 0) where src = 'seed:a' group by lower(s_name)")
def expand_seed(t: Tables) -> DataFrame:
    """Seed files, written and read again, as one list; the first file wins."""
    folder = new_folder(t.spark, "seeds")
    t.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("s"), _n(), F.lit(".test")).alias("website")).write.csv(f"{folder}/a", header=True)
    t.supplier.where("s_suppkey % 2 = 0").select(F.upper("s_name").alias("name"), F.lit("t.test").alias("website")).write.csv(f"{folder}/b", header=True)
    got = readers.read_seeds(t.spark, {"a": f"{folder}/a", "b": f"{folder}/b"})
    return got.select(F.lower("name").alias("name"), "website", "source")
