"""Records of built pages whose contents are known, and text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import text as t_
from contactmill.operators import extract

from .base import Tables, query


def _n() -> Column:
    return F.col("s_suppkey")


def _page(t: Tables, *parts) -> DataFrame:
    """One page a supplier from text and columns."""
    html = F.concat(F.lit("<html><body>"), *[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit("</body></html>"))
    return t.supplier.select(_n().alias("page_id"), html.alias("html"))


def _word(n):
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


_WORD = "translate(s_suppkey::varchar, '0123456789', 'abcdefghij')"


@query(f"""select s_suppkey as page_id, unnest(['Ann Fox' || {_WORD}, 'Bob Li', 'Cy Dow']) as name, unnest(['Partner', 'Analyst', '']) as role, unnest(['ann@x.test', '', '']) as email, unnest(['https://linkedin.com/in/ann', '', '']) as linkedin from supplier""")
def json_ld_people(t: Tables) -> DataFrame:
    """H1, H2: people of JSON-LD: direct, in a graph and as employees; broken blocks are passed over, repeats too."""
    ld = lambda *x: ('<script type="application/ld+json">', *x, "</script>")
    pages = _page(
        t, *ld('{"@type": "Person", "name": "Ann Fox', _word(_n()), '", "jobTitle": "Partner", "email": "mailto:Ann@x.test", "sameAs": ["https://linkedin.com/in/ann?x=1"]}'), *ld("{broken"),
        *ld('{"@graph": [{"@type": "Organization", "employee": [{"@type": "Person", "name": "Bob Li", "jobTitle": "Analyst"}]}, {"@type": "Person", "name": "Cy Dow"}]}'), *ld('[{"@type": "Person", "name": "BOB LI"}]'),
    )
    return extract.records(pages, "team")


@query(f"""select s_suppkey as page_id, unnest(['Ann Fox' || {_WORD}, 'Bob Li', 'Cy Dow']) as name, unnest(['Partner', 'Analyst', 'Chief Cook']) as role, unnest(['ann@x.test', '', '']) as email, unnest(['', 'https://linkedin.com/in/bob', '']) as linkedin from supplier""")
def team_records(t: Tables) -> DataFrame:
    """People of cards, then of headings with the text behind."""
    pages = _page(t, '<div><h3>Ann Fox', _word(_n()), '</h3><p>Partner</p><a href="mailto:Ann@x.test"></a></div><div><h3>Our Offices 12</h3><p>Oslo</p></div><li><h4>Bob  Li</h4> Analyst <a href="https://linkedin.com/in/bob?y"></a></li><section><h2>Team</h2><h2>Cy Dow</h2><span>Chief Cook</span></section>')
    return extract.records(pages, "team")


@query("""select s_suppkey as page_id, case when s_suppkey % 2 = 0 then n else m end as name, case when s_suppkey % 2 = 0 then '' else r end as role from supplier, (select unnest(['Ann Fox', 'Bob Li', 'Cy Dow']) as n, unnest(['Dee Roe', 'Eve Ash', null]) as m, unnest(['Partner', '', null]) as r) where s_suppkey % 2 = 0 or m is not null""")
def label_records(t: Tables) -> DataFrame:
    """H9: people of pictures' and links' labels, else of figures' captions."""
    labels = '<img alt="Ann Fox"><img alt="a logo"><a aria-label="Bob Li"></a><a title="Cy Dow" href="/c"></a><a title="Ann Fox"></a>'
    figures = "<figure><img><figcaption>Dee Roe<br>Partner<br>Oslo</figcaption></figure><figure><figcaption><div>Eve  Ash</div></figcaption></figure><figure></figure>"
    return extract.records(_page(t, F.when(_n() % 2 == 0, labels).otherwise(figures)), "team").select("page_id", "name", "role")


@query("""select s_suppkey as page_id, unnest(['Blue ' || s_nationkey, 'Red', 'Green Inc', 'Grey']) as company, unnest(['seed', '', '', '']) as stage, unnest(['https://b.test', '', '', 'https://grey.test']) as url, unnest([2019, null, null, null])::bigint as year from supplier""")
def portfolio_records(t: Tables) -> DataFrame:
    """H6: companies of cards, then logos, then outside links; the last year named."""
    pages = _page(t, "<div><h3>Blue ", F.col("s_nationkey").cast("string"), '</h3><p>Seed 2021, again 2019</p><a href="https://b.test">site</a></div><div><h4>Red</h4></div><img alt="Green Inc. logo"><img alt=""><a href="/inside">Inside</a><a href="https://grey.test">Grey</a>')
    return extract.records(pages, "portfolio").where("company <> 'site'")


@query("""select s_suppkey as page_id, unnest(['Fund ' || s_nationkey || ' raised more', 'Why we cook']) as title, unnest(['/a', '']) as url, unnest([true, false]) as is_investment from supplier""")
def post_records(t: Tables) -> DataFrame:
    """H7, H8: articles, and whether their heading tells an investment."""
    pages = _page(t, "<article><h2>Fund ", F.col("s_nationkey").cast("string"), ' raised more</h2><a href="/a">read</a></article><article><h3>Why we cook</h3></article><div><h2>One</h2><h2>Two</h2></div>')
    return extract.records(pages, "posts")


@query("""select s_suppkey as page_id, unnest([0, 1, 2])::bigint as pos, unnest(['title', 'h1', 'p']) as tag, unnest(['T', s_name, 'Text & more']) as text from supplier""")
def page_blocks(t: Tables) -> DataFrame:
    """H4: title, headings and paragraphs in order."""
    return extract.records(_page(t, "<title>T</title><h1>", F.col("s_name"), "</h1><script>var x</script><p>Text &amp;\n more</p><p> </p>"), "blocks")


@query("""select s_suppkey, 'https://www.linkedin.com/in/b;https://x.linkedin.com/in/a-' || s_suppkey as profiles, 'https://r.test/?q=' || s_suppkey as result, 'og' as description, 'Ann' as registrant, 'ann@x.test' as contact from supplier""")
def link_fields(t: Tables) -> DataFrame:
    """Profile links, targets of a result page, meta data and a registry answer."""
    html = F.concat(F.lit('<meta name="description" content="plain"><meta property="og:description" content="og"><a href="https://www.linkedin.com/in/b/?t=1">b</a> https://x.linkedin.com/in/A-'), _n(), F.lit(' https://www.linkedin.com/in/b <a href="/l/?uddg=https%3A%2F%2Fr.test%2F%3Fq%3D'), _n(), F.lit('&amp;x">'))
    who = F.struct(F.lit("Domain: x\n Registrant Name: Ann\nRegistrant Email: Ann@X.test\n").alias("w"))["w"]
    h = extract.whois(who)
    return t.supplier.select("s_suppkey", html.alias("h")).select("s_suppkey", F.array_join(F.array_sort(extract.profile_urls(F.col("h"))), ";").alias("profiles"), F.regexp_replace(F.get(extract.result_urls(F.col("h")), F.lit(0)), "&amp;x$", "").alias("result"), F.coalesce(extract.meta(F.col("h"))["og:description"], extract.meta(F.col("h"))["description"]).alias("description"), h["name"].alias("registrant"), h["email"].alias("contact"))


@query("""select s_suppkey, 'ann' || s_suppkey || '@blue.test,bob@red.co' as emails, 'ann' || s_suppkey || '@blue.test,cy@mail.test,dee@x.org,eve@at.test' as html_emails from supplier""")
def address_extract(t: Tables) -> DataFrame:
    """Addresses of texts and of pages, plain, linked and obfuscated."""
    text = F.concat(F.lit("Write to ann"), _n(), F.lit("@blue.test or bob@red.co, not logo@2x.png or me@example.com"))
    html = F.concat(F.lit('<a href="mailto:ann'), _n(), F.lit('@blue.test">x</a> cy [at] mail [dot] test <b data-m="dee&#64;x.org"></b> eve(at)at.test'))
    return t.supplier.select("s_suppkey", F.array_join(F.filter(t_.emails(text), t_.email_ok), ",").alias("emails"), F.array_join(t_.emails_in_html(html), ",").alias("html_emails"))


@query("select s_suppkey, s_suppkey % 4 <> 3 as unwanted from supplier")
def address_rejects(t: Tables) -> DataFrame:
    """P20: addresses with an ignored part, of an odd length or of another domain."""
    m = _n() % 4
    e = F.when(m == 0, "noreply@x.test").when(m == 1, "a@b").when(m == 2, "ann@y.test").otherwise("Ann@x.test")
    return t.supplier.select("s_suppkey", t_.reject_email(e, ("noreply",), F.lit("x.test")).alias("unwanted"))


@query("select s_suppkey, case s_suppkey % 3 when 0 then 'Managing Partner' when 1 then 'Vice President Oslo' else 'Investor Relations' end as role, case s_suppkey % 3 when 0 then 'Ann Fox' when 1 then 'Bob Li' else 'Cy' end as person, case s_suppkey % 3 when 0 then 'checks of $1M to $5M' when 1 then '$250k - $2M initial' end as checks, case s_suppkey % 3 when 0 then 'Oslo' when 1 then 'Austin, TX' else 'City' || s_suppkey || ', Vestland' end as place from supplier")
def prose_fields(t: Tables) -> DataFrame:
    """Roles, salutations, check sizes and places from prose, places from JSON-LD first."""
    m = _n() % 3
    pick = lambda a, b, c: F.when(m == 0, a).when(m == 1, b).otherwise(c)
    role = t_.role_text(pick("ManagingPartner Menlo Park", "Vice  President\nOslo", "Based InBay AreaSpecialtySpecialistsFocusInvestor Relations"))
    person = t_.clean_person_name(pick("Meet Ann Fox..", "Dr. Bob Li", "Cy"))
    checks = t_.first_match(pick("We write checks of $1M to $5M early", "from $250k - $2M initial", "nothing"), t_.CHECK_FORMS)
    blocks = F.array(F.lit('{"@type": "WebSite"}'), pick('{"address": {"addressRegion": "TX"}}', '{"name": "x"}', F.concat(F.lit('{"address": {"addressLocality": "City'), _n(), F.lit('", "addressRegion": "Vestland"}}'))))
    where = t_.place(pick("We are based in Oslo.", "Write to Austin, TX today", "based in Paris."), blocks)
    return t.supplier.select("s_suppkey", role.alias("role"), person.alias("person"), checks.alias("checks"), where.alias("place"))


@query("""with a as (select s_suppkey, 'd' || s_suppkey || '.test' as domain, case s_suppkey % 4 when 0 then 'Blue ' || s_name when 1 then s_name when 2 then 'd' || s_suppkey || '.test' end as name, case when s_suppkey % 4 <> 3 then 'ann' || s_suppkey || '@x.test' end as email from supplier)
select c_custkey, coalesce(a.email, case when c_custkey % 2 = 0 then 'own@x.test' end) as email, a.name as registrant from customer left join a on a.email is not null and a.s_suppkey = c_custkey % (select count(*) from supplier)""")
def registry_emails(t: Tables) -> DataFrame:
    """registrants' names and addresses of registry answers, joined to contacts by domain."""
    m = _n() % 4
    line = F.when(m == 0, F.concat(F.lit("Domain: x\r\n  org-name: REDACTED FOR PRIVACY\r\nowner:   Blue "), "s_name", F.lit("\r\nOrganization: No"))).when(m == 1, F.concat(F.lit("Registrant Name: A\nregistrant organization: "), "s_name")).otherwise("Registrant Name: Redacted")
    address = F.when(m == 3, "abuse@registrar.test hostmaster@x.test a@iana.org").otherwise(F.concat(F.lit("privacy@x.test Ann"), _n(), F.lit("@X.test. bob@y.test")))
    answers = t.supplier.select(F.concat(F.lit("d"), _n(), F.lit(".test")).alias("domain"), F.concat(line, F.lit("\nEmail: "), address).alias("answer"))
    found = extract.registry_contacts(answers).select("domain", F.col("name").alias("registrant"), F.col("email").alias("found"))
    count = F.broadcast(t.supplier.agg(F.count(F.lit(1)).alias("many")))  # one row
    rows = t.customer.join(count).select("c_custkey", F.concat(F.lit("d"), F.col("c_custkey") % F.col("many"), F.lit(".test")).alias("domain"), F.when(F.col("c_custkey") % 2 == 0, "own@x.test").alias("own"))
    return rows.join(found, "domain", "left").select("c_custkey", F.coalesce("found", "own").alias("email"), "registrant")


@query("select s_suppkey, s_suppkey % 3 <> 2 as team, case s_suppkey % 3 when 0 then 'homepage mentions ''board seat'';Ann bio mentions ''board member''' when 1 then 'news: ''Ann joins'' mentions ''joins the board''' else '' end as board from supplier")
def team_paths_and_boards(t: Tables) -> DataFrame:
    """Addresses of team pages; mentions of board seats, five at most."""
    m = _n() % 3
    url = F.when(m == 0, "https://x.test/Our-Team/").when(m == 1, "https://x.test/about").otherwise("https://team.test/blog")
    bios = F.when(m == 0, F.array(F.struct(F.lit("Ann").alias("name"), F.lit("A Board Member, sits on the board").alias("bio")))).otherwise(F.array(F.struct(F.lit("Bob").alias("name"), F.lit("cooks").alias("bio"))))
    news = F.array(F.struct(F.lit("Ann joins").alias("headline"), F.when(m == 1, "she joins the board").otherwise("us").alias("snippet")))
    said = t_.board_signals(F.when(m == 0, "We take a board seat"), bios, news)
    return t.supplier.select("s_suppkey", t_.is_team_path(url).alias("team"), F.array_join(said, ";").alias("board"))
