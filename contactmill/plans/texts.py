"""Text, pages and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.functions import text as t_
from contactmill.operators import extract, phrases, scoring, state
from contactmill.sources import readers

from .base import Tables, query

BUCKETS = {"money": ["token", "secret", "password"], "place": ["tion", "heit", "ment"], "noise": ["###", "&&&", "!!"]}
_HOST = "nullif(regexp_replace(lower(regexp_extract({}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)', 1)), '^www\\.', ''), '')"
_PATH = "regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)', 1)), '^/+|/+$', '', 'g')"


@query("""with e as (select doc_id, unnest(regexp_extract_all(replace(text, 'example.com', 'blue.test'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,15}')) as e from documents), c as (select distinct doc_id, lower(e) as e from e where regexp_matches(e, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]+$')
and not regexp_matches(e, '\\.png|\\.jpg|\\.svg|\\.gif|\\.css|\\.js|example\\.com|email\\.com|domain\\.com|sentry\\.io|wixpress|sentry-next'))
select doc_id, string_agg(e, ',' order by e) as emails from c group by doc_id""")
def email_extract(t: Tables) -> DataFrame:
    """Addresses in lower case (P16 changes no other kind here). The tables' own ones are all on a host that is
    refused, so another stands in for it."""
    found = F.filter(t_.emails(F.replace("text", F.lit("example.com"), F.lit("blue.test"))), t_.email_ok)
    return t.documents.select("doc_id", F.array_join(found, ",").alias("emails")).where("emails != ''")


@query("""with y as (select page_id, html, regexp_extract_all(html, '\\b(20[0-2]\\d)\\b', 1) as l, array_concat(array_concat(regexp_extract_all(html, '\\b\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{2,4}\\b'), regexp_extract_all(html, '(?i)\\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\w*\\s+\\d{1,2},?\\s+\\d{4}\\b')), regexp_extract_all(html, '\\b\\d{4}[/\\-]\\d{2}[/\\-]\\d{2}\\b')) as d from pages)
select page_id, l[len(l)]::bigint as last_year, list_max(l)::bigint as latest_year, len(d)::bigint as n_dates from y""")
def year_date_extract(t: Tables) -> DataFrame:
    """P23, P24."""
    return t.pages.select("page_id", t_.last_year(F.col("html")).alias("last_year"), t_.latest_year(F.col("html")).alias("latest_year"), F.size(t_.dates(F.col("html"))).alias("n_dates"))


@query("select doc_id, bucket, n from (select doc_id, unnest(['money', 'noise', 'place']) as bucket, unnest([contains(t, 'token')::bigint + contains(t, 'secret')::bigint + contains(t, 'password')::bigint, contains(t, '###')::bigint + contains(t, '&&&')::bigint + contains(t, '!!')::bigint, contains(t, 'tion')::bigint + contains(t, 'heit')::bigint + contains(t, 'ment')::bigint]) as n from (select doc_id, lower(text) as t from documents)) where n > 0")
def keyword_buckets(t: Tables) -> DataFrame:
    """P25, J20."""
    return t.documents.select("doc_id", F.explode(t_.keyword_counts(F.col("text"), BUCKETS)).alias("bucket", "n"))


@query("""with p as (select distinct lower(trim(unnest(string_split_regex(text, '[.!?\n]+')))) as phrase from benchmark)
select doc_id, phrase from documents join p on phrase <> '' and contains(lower(text), phrase)""")
def phrase_hits(t: Tables) -> DataFrame:
    """Sentences of the benchmark that stand in documents, by one automaton."""
    p = t.benchmark.select(F.explode(F.split("text", r"[.!?\n]+")).alias("phrase")).select(F.lower(F.trim("phrase")).alias("phrase")).where("phrase != ''").distinct()
    return phrases.phrase_hits(t.documents, p, ["doc_id"])


_DIGEST = "left(sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))), 16)"


@query(f"select digest, count(*) as n, min(page_id) as first_id from (select page_id, {_DIGEST.format('html')} as digest from pages) group by digest")
def content_hash_dups(t: Tables) -> DataFrame:
    """P30, R3."""
    return t.pages.select("page_id", t_.content_hash(F.col("html")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))


@query(f"select page_id, {_HOST.format('url')} as host, nullif(replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)', 1)), 'www.', ''), '') as host_loose, nullif(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1), '') as base, {_PATH} as path, not contains({_HOST.format('url')}, 'example.org') and not ends_with({_HOST.format('url')}, '.edu') and not regexp_matches({_HOST.format('url')}, '(^|\\.)(news|blog)\\.') as wanted from pages")
def url_parts(t: Tables) -> DataFrame:
    """P10 to P12, P14."""
    u = F.col("url")
    return t.pages.select("page_id", t_.host(u).alias("host"), t_.host_loose(u).alias("host_loose"), t_.base_url(u).alias("base"), t_.url_path(u).alias("path"), readers.valid_domain(t_.host(u), ("example.org",), (".edu",)).alias("wanted"))


@query(f"with p as (select page_id, {_PATH} as path from pages), s as (select *, string_split(path, '/') as g from p) select page_id, path, round(case when path = '' then null when list_has_any(g, ['fr', 'en', 'blog']) then 0.9::double when contains(path, 'fr') or contains(path, 'en') or contains(path, 'blog') then 0.7::double end * case when len(g) > 2 then 0.8::double else 1.0::double end, 4) as score from s")
def url_page_type(t: Tables) -> DataFrame:
    """C20."""
    path = t_.url_path(F.col("url"))
    return t.pages.select("page_id", path.alias("path")).select("page_id", "path", scoring.page_type_score(F.col("path"), ("fr", "en", "blog")).alias("score"))


@query("""select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>'))::bigint as n_links, regexp_extract(regexp_extract(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>'), '(?i)href="([^"]*)"', 1) as first_link, regexp_extract(html, '(?i)<meta\\s[^>]*name="viewport"[^>]*>') <> '' as has_viewport from pages""")
def html_meta_links(t: Tables) -> DataFrame:
    """H3: title, links and meta data."""
    h = F.col("html")
    return t.pages.select("page_id", extract.title(h).alias("title"), F.size(extract.links(h)).alias("n_links"), F.coalesce(F.get(extract.links(h), F.lit(0))["url"], F.lit("")).alias("first_link"), extract.meta(h).getItem("viewport").isNotNull().alias("has_viewport"))


@query()
def html_title_blocks(t: Tables) -> DataFrame:
    """H4: blocks of each page's tree."""
    return extract.records(t.pages, "blocks")


@query("select conv_id, turn, role, next_role from (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as next_role from conversations)")
def next_line_role(t: Tables) -> DataFrame:
    """W11."""
    from pyspark.sql import Window

    return t.conversations.select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


@query("""select event_id, event_type as name, props->>'$.k' as value from events""")
def json_list_parse(t: Tables) -> DataFrame:
    """S3: objects of lists under a usual key, with keys in any spelling."""
    text = F.concat(F.lit('{"data": [{"Firm-Name": "'), "event_type", F.lit('", "K_": "'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    rows = t.events.select("event_id", text.alias("j"))
    return readers.json_list(rows, "j", {"name": ("name", "firmname"), "value": ("k",)})


@query("""with l as (select doc_id, unnest(range(len(s))) as pos, unnest(s) as line from (select doc_id, string_split(text, chr(10)) as s from documents))
select doc_id, pos::bigint as pos, length(line)::bigint as n, line like 'The %' as the from l""")
def line_parse(t: Tables) -> DataFrame:
    """Numbered lines, from which S5, S6 and S12 start."""
    rows = readers.numbered_lines(t.documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", "pos", F.length("line").alias("n"), F.startswith("line", F.lit("The ")).alias("the"))


@query("""select s_suppkey, row::bigint as row, 'Name,Place' as header, case row when 0 then s_name || ',' || s_nationkey else 'Other,' || s_suppkey end as cells from supplier, (select unnest(range(2)) as row)""")
def table_parse(t: Tables) -> DataFrame:
    """A pipe table within a text."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.concat(F.lit("About\n\n| Name | Place |\n|---|:-:|\n| "), "s_name", F.lit(" | "), n, F.lit(" |\n| Other | "), s, F.lit(" |\n\n| Second | table |"))
    out = readers.markdown_table(t.supplier.select("s_suppkey", text.alias("text")), "text", "s_suppkey")
    return out.select("s_suppkey", "row", F.array_join("header", ",").alias("header"), F.array_join("cells", ",").alias("cells"))


@query("""select s_suppkey, pos::bigint as pos, case pos when 1 then s_name else 'Other' end as name, 'https://' || case pos when 1 then 's' else 'o' end || s_suppkey || '.test' as website from supplier, (select unnest([1, 4]) as pos)""")
def bullet_parse(t: Tables) -> DataFrame:
    """Links of bulleted lines."""
    s = F.col("s_suppkey")
    text = F.concat(F.lit("Partners\n* ["), "s_name", F.lit("](https://s"), s, F.lit(".test) since 2001\n[No bullet](https://n.test)\n- [ab](https://short.test)\n  + [Other](https://o"), s, F.lit(".test)"))
    return readers.bullets(t.supplier.select("s_suppkey", text.alias("text")), "text").select("s_suppkey", "pos", "name", "website")


@query("select source, lang, arg_max(doc_id, n_chars * 1000000 - doc_id) as doc_id, max(n_chars) as n_chars from documents group by source, lang")
def top_thesis(t: Tables) -> DataFrame:
    """The best of each group, the first in a tie."""
    return t.documents.groupBy("source", "lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("""select doc_id, case when contains(l, 'pre-seed') then 'Pre-Seed' when contains(l, 'seed') then 'Seed' when contains(l, 'growth') then 'Growth' when contains(l, 'public') then 'Public' when contains(l, 'ipo') then 'IPO' else '' end as stage, case when contains(l, 'director') then 60 when contains(l, 'talent') then 10 else 0 end::bigint as title
from (select doc_id, case doc_id % 4 when 0 then 'A Seed director' when 1 then 'pre-seed talent' when 2 then 'growth' else 'none' end as t, lower(t) as l from documents)""")
def stage_and_title(t: Tables) -> DataFrame:
    """P22, P29."""
    m = F.col("doc_id") % 4
    text = F.when(m == 0, "A Seed director").when(m == 1, "pre-seed talent").when(m == 2, "growth").otherwise("none")
    return t.documents.select("doc_id", t_.detect_stage(text).alias("stage"), t_.title_score(text).alias("title"))


@query("select p_partkey, p_brand || ' Holdings' as company, trim(split_part(p_name, ' ', 1)) as first, split_part(p_name, ' ', 2) as rest, true as looks, case when p_partkey % 3 = 0 then null else 'a' || p_partkey || '@x.test' end as email from part")
def contact_fields(t: Tables) -> DataFrame:
    """Fields as a receiver wants them."""
    first, rest = t_.split_name(F.col("p_name"))
    name = t_.clean_company_name(F.concat(F.col("p_brand"), F.lit("  Holdings.,")))
    email = F.when(F.col("p_partkey") % 3 == 0, "n@x.test (invalid)").otherwise(F.concat(F.lit(" a"), "p_partkey", F.lit("@x.test second")))
    return t.part.select("p_partkey", name.alias("company"), first.alias("first"), rest.alias("rest"), t_.looks_like_company(name).alias("looks"), t_.usable_email(email).alias("email"))


@query(f"select domain, count(*) as n from (select {_HOST.format('url')} as domain from pages) where domain not in (select {_HOST.format('url')} from pages where page_id % 5 = 0) group by domain")
def target_list(t: Tables) -> DataFrame:
    """New hosts of a target list."""
    seen = t.pages.where("page_id % 5 = 0").select(t_.host(F.col("url")).alias("domain"))
    return readers.target_list(t.pages.select(F.col("url").alias("value")), seen).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey, 'NATION_' || s_nationkey as company, 'D' as form, s_suppkey::varchar as cik, '2001-0' || (s_suppkey % 9 + 1) || '-15' as filed from supplier where s_suppkey % 3 <> 2 order by s_suppkey")
def filing_index(t: Tables) -> DataFrame:
    """Fixed-width lines."""
    s = F.col("s_suppkey")
    line = F.concat(F.rpad(F.concat(F.lit("NATION_"), "s_nationkey"), 62, " "), F.when(s % 3 == 2, "10-K").otherwise("D"), F.lit("  "), F.lpad(s.cast("string"), 8, "0"), F.lit("  2001-0"), s % 9 + 1, F.lit("-15  edgar/"), s, F.lit(".txt"))
    out = readers.company_index(t.supplier.select(line.alias("value")))
    return out.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("s_suppkey"), "company", "form", "cik", F.col("filed").cast("string").alias("filed"))


@query("select user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type), ['x']))), ',') as tags, 90 * (2 ** least(count(*) % 4, 3))::bigint as wait from events group by user_id")
def tags_and_backoff(t: Tables) -> DataFrame:
    """U6, R5."""
    rows = t.events.groupBy("user_id").agg(F.array_join(F.collect_set("event_type"), ",").alias("tags"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", state.add_tags(F.col("tags"), F.lit("x")).alias("tags"), state.backoff(F.least(F.col("n") % 4, F.lit(3)), cap=720).alias("wait"))
