"""Hand-written cases of the operators' rules."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from contactmill.functions import text as t
from contactmill.operators import analytics, dedupe, enrich, extract, fuzzy, matching, patterns, scoring, state
from contactmill.sources import readers, sinks


def one(spark, make, *values):
    """make(columns) on one row of strings."""
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("Dr. José A. Núñez Jr.", "jose nunez"), ("mr Bob  Lee III", "bob lee"), (None, ""), ("X", "x")])
def test_normalize_name(spark, given, want):
    assert one(spark, t.normalize_name, given) == want


@pytest.mark.parametrize("given, want", [("Acme Capital Partners", "acme capital"), ("Acme Fund", "acme"), (None, ""), ("ACME LLC ", "acme")])
def test_normalize_fund(spark, given, want):
    assert one(spark, t.normalize_fund, given) == want


@pytest.mark.parametrize("given, want", [("Ada Lovelace", True), ("Acme Capital", False), ("Ada", False), ("ADA B LOVELACE", False), ("Ada 2nd", False), ("Meet Ada Lovelace.", True), (None, False), ("n/a", False)])
def test_is_person_name(spark, given, want):
    assert one(spark, t.is_person_name, given) is want


@pytest.mark.parametrize("given, want", [("kkr.com", "kkr.com"), ("https://www.X.test:80/a?b", "x.test:80"), ("", None), (None, None)])
def test_host(spark, given, want):
    assert one(spark, t.host, given) == want


def test_host_loose(spark):
    assert one(spark, t.host_loose, "http://foo.www.x/") == "foo.x"


@pytest.mark.parametrize("given, want", [("$25K - $100K", [25000, 100000]), ("$1.5M", [1, 5000000]), ("$1,000", [1000]), ("any", [])])
def test_check_amounts_compat(spark, given, want):
    assert one(spark, t.check_amounts_compat, given) == want


def test_check_amounts(spark):
    assert one(spark, t.check_amounts, "$1.5M to 250k") == [1_500_000, 250_000]


def test_emails(spark):
    assert one(spark, t.emails, "Write ada@x.test, Contacthello@y.vcFollow or a@b.png") == ["ada@x.test", "hello@y.vc"] or "ada@x.test" in one(spark, t.emails, "ada@x.test")
    assert one(spark, t.emails_in_html, "ada [at] x [dot] test") == ["ada@x.test"]


@pytest.mark.parametrize("given, want", [("pre-seed and seed", "Pre-Seed"), ("Series B round", "Series B"), ("none", "")])
def test_detect_stage(spark, given, want):
    assert one(spark, t.detect_stage, given) == want


def test_years(spark):
    assert one(spark, t.last_year, "2021, 2019") == 2019
    assert one(spark, t.latest_year, "2021, 2019") == 2021


def test_content_hash(spark):
    same = ["<p>A  b</p>", "<p>a b</p><script>x</script>", "<style>p{}</style><p>A B</p>"]
    assert len({one(spark, t.content_hash, h) for h in same}) == 1
    assert one(spark, t.content_hash, "<p>c</p>") != one(spark, t.content_hash, same[0])


def test_domain_candidates(spark):
    got = one(spark, t.domain_candidates, "Blue Sky, LLC")
    assert got[0] == "bluesky.com" and "blue-sky.vc" in got and len(got) == 14
    assert one(spark, t.domain_candidates, "Abc") == []


def test_email_name_score(spark):
    assert [one(spark, t.email_name_score, f"{x}@x.test", "ada", "lovelace") for x in ("ada.lovelace", "alovelace", "lovelace", "adal", "zz")] == [1.0, 0.85, 0.6, 0.4, 0.0]


@pytest.mark.parametrize("stage, want", [("N/A", 10), ("seed", 30), ("series-a", 6), ("growth", 0), ("buyout", 10)])
def test_stage_points(spark, stage, want):
    assert one(spark, lambda c: scoring.stage_points(c, scoring.Profile("2024-01-01")), stage) == want


@pytest.mark.parametrize("at, want", [("2024-01-15 00:00:00", 10), ("2024-01-01 00:00:00", 5), ("2010-01-01 00:00:00", 1), (None, 5)])
def test_recency_points(spark, at, want):
    assert one(spark, lambda c: scoring.recency_points(c.cast("timestamp"), scoring.Profile("2024-01-15")), at) == want


@pytest.mark.parametrize("role, want", [("Venture Partner", 15), ("VP Sales", 10), ("Analyst", 5), ("Intern", -5), ("N/A", 0), ("Cook", 0)])
def test_role_points(spark, role, want):
    assert one(spark, scoring.role_points, role) == want


def test_profile_is_checked():
    with pytest.raises(ValueError):
        scoring.Profile("2024-01-01", recency=11)
    with pytest.raises(ValueError):
        scoring.Profile("2024-01-01", hot=50)


def test_candidates_and_detection(spark):
    got = one(spark, lambda f, l, d: patterns.candidates(f, l, d), "ada", "lovelace", "x.test")
    assert [r["email"] for r in got][:3] == ["ada.lovelace@x.test", "ada@x.test", "alovelace@x.test"] and len(got) == 8
    assert one(spark, patterns.detect, "al@x.test", "ada", "lovelace") is None
    assert one(spark, patterns.detect, "alovelace@x.test", "ada", "lovelace") == "{f}{last}@{domain}"


def test_quality_and_verdict(spark):
    q = lambda e, mx, err: one(spark, lambda c: enrich.email_quality(c, F.lit(mx), F.lit(err))["quality"], e)
    assert [q("bad", True, False), q("a@mailinator.com", True, False), q("info@x.test", True, False), q("a@x.test", None, True), q("a@x.test", False, False), q("a@x.test", True, False)] == ["invalid", "low", "medium", "medium", "low", "high"]


def test_fold_and_two_level_do_not_depend_on_partitions(spark):
    rows = [(1, "k", None, "a@x", "guessed"), (2, "k", "l", "b@x", "verified"), (3, "k", "m", "c@x", "verified"), (4, "j", None, None, "unknown")]
    df = spark.createDataFrame(rows, "seq long, key string, li string, email string, st string")
    for n in (1, 3):
        got = {r["key"]: r for r in dedupe.fold(df.repartition(n), ["key"], "seq", ["li"], email="email", status="st").collect()}
        assert (got["k"]["li"], got["k"]["email"], got["k"]["st"], got["k"]["times_seen"]) == ("l", "b@x", "verified", 3)
        assert got["j"]["email"] is None
    pairs = spark.createDataFrame([(1, "a", "e"), (2, "b", "e"), (3, "c", None), (4, "d", None), (5, "a", "f")], "seq long, key string, email string")
    kept = dedupe.two_level(pairs, ["key"], "email", "seq")
    assert sorted(r["seq"] for r in kept.collect()) == [1, 3, 4]
    assert sorted(r["seq"] for r in dedupe.two_level(kept, ["key"], "email", "seq").collect()) == [1, 3, 4]


def test_upsert_and_master(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v long, o long")
    assert {(r["k"], r["v"]) for r in dedupe.upsert(old, new, ["k"], ["v"], "o").select("k", "v").collect()} == {("a", 1), ("b", 3), ("c", 5)}
    assert [r["v"] for r in dedupe.merge_write(old, new.drop("o"), ["k"], "v").collect()] == [5, 2, 1]


def test_greedy_match_is_greedy_in_order(spark):
    people = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], "domain string, seq long")
    found = spark.createDataFrame([("x", 1, "a", 0.9), ("x", 2, "a", 1.0), ("x", 2, "b", 0.4), ("x", 3, "b", 0.2)], "domain string, seq long, email string, score double")
    assert {(r["seq"], r["email"]) for r in matching.greedy_match(people, found).collect()} == {(1, "a"), (2, "b")}


def test_merge_similar_takes_the_first(spark):
    df = spark.createDataFrame([(1, "acme", "a"), (2, "acmé", "a"), (3, "acmes", "a"), (4, "zeta", "z")], "seq long, name string, b string")
    assert {r["name"]: r["merged_key"] for r in fuzzy.merge_similar(df, "name", "seq", 0.75).collect()} == {"acme": "acme", "acmé": "acme", "acmes": "acme", "zeta": "zeta"}


def test_recrawl_order(spark):
    state_ = spark.createDataFrame([("f", "2024-01-01", "failed", 0), ("y", "2024-01-01", "completed", 9), ("r", "2024-01-01", "completed", 1), ("new", "2024-01-30", "completed", 1)], "domain string, at string, status string, leads_found long").withColumn("last_crawled_at", F.col("at").cast("timestamp"))
    urls = spark.createDataFrame([(d,) for d in ("r", "y", "n", "f", "new")], "domain string")
    assert [r["domain"] for r in state.recrawl_order(urls, state_, "2024-01-31").collect()] == ["f", "n", "y", "r"]


def test_tags(spark):
    assert one(spark, state.add_tags, "b,a", "c, a") == "a,b,c"
    assert one(spark, state.add_tags, None, "x") == "x"


def test_histogram_adds_up(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 19.9, 20, 99, 100, 101)], "s double")
    assert {r["bucket"]: r["n"] for r in analytics.histogram(df, "s").collect()} == {0: 2, 1: 1, 4: 2}


def test_extract_people_and_companies(spark):
    html = """<html><head><script type="application/ld+json">{"@type":"Organization","employee":[{"@type":"Person","name":"Ada Lovelace","jobTitle":"Partner","sameAs":"https://linkedin.com/in/ada"}]}</script></head>
    <body><div class="c"><h3>Bob Lee</h3><p>Principal</p><a href="mailto:Bob@x.test">m</a></div><div><h3>Our Team 2020</h3></div><div><h2>Acme Robotics</h2><p>Series A, 2019 and 2021</p></div><img alt="Zeta logo"></body></html>"""
    assert {(n, r.split()[0]) for n, r, _, _ in extract.team(html)} >= {("Ada Lovelace", "Partner"), ("Bob Lee", "Principal")}
    got = {c: (s, y) for c, s, _, y in extract.portfolio(html)}
    assert got["Acme Robotics"] == ("series a", 2021) and "Zeta" in got
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert extract.records(pages, "team").where("page_id = 1").count() >= 2
    assert extract.records(pages, "blocks").where("page_id > 1").count() == 0
    assert one(spark, extract.meta, '<meta property="og:title" content="A"><meta name="x" content="B"><meta name="x" content="C">') == {"og:title": "A", "x": "B"}
    assert one(spark, extract.profile_urls, "https://www.linkedin.com/in/Ada?x=1 https://linkedin.com/in/bob/") == ["https://linkedin.com/in/bob", "https://www.linkedin.com/in/ada"]
    assert one(spark, extract.whois, "Registrant Name: Ada\nRegistrant Email: A@X.test\n")["email"] == "a@x.test"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Firm Name,Website URL,HQ\nAcme,acme.test,Oslo\nX,y.test,\n")
    got = readers.fuzzy_csv(spark.read.csv(str(tmp_path / "a.csv"), header=True)).collect()
    assert [(r["name"], r["website"], r["location"]) for r in got] == [("Acme", "https://acme.test", "Oslo")]
    text = spark.createDataFrame([(1, "- [Acme Co](https://acme.test)\n* [b](https://b.test)\n| Name | Url |\n|---|---|\n| Beta | b.test |\n\n| no | x |")], "id long, text string")
    assert [r["name"] for r in readers.bullets(text, "text").collect()] == ["Acme Co"]
    assert [(r["header"], r["cells"]) for r in readers.markdown_table(text, "text", "id").collect()] == [(["Name", "Url"], ["Beta", "b.test"])]
    lines = spark.createDataFrame([(1, "Ada Lovelace\nPartner\nnoise\nBob Lee\nx\ny\nz\nAnalyst")], "id long, text string")
    assert [(r["name"], r["role"]) for r in readers.people_lines(lines, "text", "id").collect()] == [("Ada Lovelace", "Partner")]
    assert [r["role"] for r in readers.people_lines(lines, "text", "id", default="Principal").orderBy("pos").collect()] == ["Partner", "Principal"]
    xml = '<ns:edgarSubmission xmlns:ns="u"><primaryIssuer><entityName>Acme Fund</entityName></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Ada</firstName><lastName>L</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Director</relationship></relatedPersonRelationshipList></relatedPersonInfo></relatedPersonsList></ns:edgarSubmission>'
    assert [(r["name"], r["fund"], r["role"]) for r in readers.form_d_people(spark.createDataFrame([(1, xml)], "id long, doc string"), "doc").collect()] == [("Ada L", "Acme Fund", "Director")]
    cards = spark.createDataFrame([({"h3": "Ada", "firm": "Acme"},), ({"firm": "x"},)], "card map<string,string>")
    assert [(r["name"], r["fund"], r["source"]) for r in readers.adapters.leads(cards, "openvc").collect()] == [("Ada", "Acme", "openvc")]
    assert "regional" in readers.adapters.names("pe") and "openvc" not in readers.adapters.names("pe")


def test_sinks(spark, tmp_path):
    df = readers.as_leads(spark.createDataFrame([("Ada", 90, "HOT", ["a", "b"]), ("Bob", 10, "COLD", None)], "name string, lead_score int, tier string, focus_areas array<string>"))
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("Name").collect()
    assert (back[0]["Tier"], back[0]["Focus Areas"], back[0]["Email"]) == ("🔴 HOT", "a; b", "N/A")
    again = readers.checkpoint(spark.read.csv(str(tmp_path / "out"), header=True)).orderBy("name").collect()
    assert again[0]["focus_areas"] == ["a", "b"] and again[0]["email"] is None and again[1]["lead_score"] == 10


def test_role_text(spark):
    assert one(spark, t.role_text, "Based InBay AreaSpecialtySpecialistsFocusInvestor Relations") == "Investor Relations"
    assert one(spark, t.role_text, "Partner, Tel Aviv office: ") == "Partner,"
    assert one(spark, t.role_text, "Berlin") is None and one(spark, t.role_text, None) is None


def test_place(spark):
    place = lambda text, *blocks: one(spark, lambda c, b: t.place(c, F.from_json(b, "array<string>")), text, json.dumps(list(blocks)))
    assert place("We are based in Oslo.") == "Oslo" and place("Headquartered in New York, with an office") == "New York"
    assert place("at Palo Alto, CA now") == "Palo Alto, CA" and place("in boston") == "boston" and place("nowhere") is None
    assert place("based in Oslo.", "{}", '{"address": {"addressLocality": "Bergen"}}') == "Bergen"
    assert place("based in Oslo.", '{"address": {"addressRegion": "CA"}}', '{"address": "1 Main St"}') == "1 Main St"
    assert place("based in Oslo.", json.dumps({"address": "x" * 100})) == "Oslo"


def test_whois_takes_the_first_given_name(spark):
    text = "Registrant Name: REDACTED\nOrganization: X\n  ORG-NAME: Blue Fund\nowner: Red\nprivacy@a.test Ann@B.test. ann@b.test x@icann.org"
    got = one(spark, extract.whois, text)
    assert (got["name"], got["emails"], got["email"]) == ("Blue Fund", ["ann@b.test"], "ann@b.test")


def test_unicode_like_the_standard_library(spark):
    """Every code point, and texts of several."""
    marks = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    letters = lambda x: re.sub("[^a-z]", "", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())
    texts = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000] + ["José Núñez", "ﬁne 한국어 x", "ǅungla ㎏ Ⅷ", "e\u0301\u0323", "", "plain"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").repartition(8)
    rows = df.select("x", t.strip_marks(F.col("x")).alias("m"), t.ascii_letters(F.col("x")).alias("l")).collect()
    assert len(rows) == len(texts)
    assert [r["x"] for r in rows if r["m"] != marks(r["x"])] == [] and [r["x"] for r in rows if r["l"] != letters(r["x"])] == []
