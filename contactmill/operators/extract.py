"""Records from HTML: built-in expressions where a pattern will do, a tree where it won't.

The tree comes from the standard library's tolerant parser, in table functions that read one page at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
PROFILE_URL = r"https?://(?:[a-z]+\.)?linkedin\.com/in/[A-Za-z0-9_%-]+/?"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INVEST = ("invested", "led", "co-led", "participated", "backed", "announced", "closed", "raised", "funded", "seed round", "series", "joined", "co-invested", "invested in", "portfolio company")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack += reversed(n.children)
        return re.sub(r"\s+", " ", " ".join(out)).strip()

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag: str, attrs) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.open[0]


def json_ld(html: str | None) -> list:
    """H1: all objects of the page's JSON-LD blocks; broken blocks are passed over."""
    out = []
    for n in parse(html).find("script"):
        if n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                got = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except ValueError:
                continue
            out += got if isinstance(got, list) else [got]
    return [x for x in out if isinstance(x, dict)]


def _people(items: list) -> Iterator[dict]:
    for x in items:
        if not isinstance(x, dict):
            continue
        if x.get("@type") == "Person":
            yield x
        for key in ("@graph", "member", "members", "employee", "employees", "founder"):
            inner = x.get(key)
            if inner:
                yield from _people(inner if isinstance(inner, list) else [inner])


def person_like(name: str) -> bool:
    """2 to 5 capitalised words of letters, 4 to 40 characters."""
    ws = name.split()
    return 4 <= len(name) <= 40 and 2 <= len(ws) <= 5 and all(re.fullmatch(r"[^\W\d_][\w.'’-]*", w) and w[0].isupper() for w in ws)


def team(html: str | None) -> list[tuple[str, str, str, str]]:
    """H2, H5, H9: (name, role, email, linkedin): JSON-LD first, then cards, then headings with the text behind; where none
    of these has a person, labels of pictures and links, then captions of figures. By name once."""
    tree, out = parse(html), {}

    def add(name: str, role: str, email: str = "", url: str = "") -> None:
        name = re.sub(r"\s+", " ", name).strip()
        if person_like(name) and name.lower() not in out:
            out[name.lower()] = (name, role.strip(), email.removeprefix("mailto:").lower(), url.partition("?")[0])

    for p in _people(json_ld(html)):
        same = p.get("sameAs") or ""
        same = same if isinstance(same, list) else [same]
        add(str(p.get("name") or ""), str(p.get("jobTitle") or ""), str(p.get("email") or ""), next((str(u) for u in same if "linkedin.com" in str(u)), ""))
    if len(out) < 3:
        for card in tree.find("div", "li", "article", "section"):
            heads = [n for n in card.walk() if n.tag in HEADINGS]
            if len(heads) == 1 and len(card.text()) <= 500:
                name = heads[0].text()
                rest = card.text().replace(name, "", 1).strip()
                links = [a.attrs.get("href", "") for a in card.find("a")]
                add(name, rest.split("  ")[0], next((x for x in links if x.startswith("mailto:")), ""), next((x for x in links if "linkedin.com/in/" in x), ""))
    if len(out) < 3:
        flat = [n for n in tree.walk() if n.tag in HEADINGS or n.tag in ("p", "span")]
        for a, b in zip(flat, flat[1:]):
            if a.tag in HEADINGS and b.tag not in HEADINGS:
                add(a.text(), b.text())
    if not out:
        for n in tree.walk():
            for label in (n.attrs.get("alt", "") if n.tag == "img" else "", n.attrs.get("aria-label", ""), n.attrs.get("title", "") if n.tag == "a" else ""):
                add(label, "")
    if not out:
        for figure in tree.find("figure"):
            for caption in figure.find("figcaption")[:1]:
                said = lines(caption)
                add(said[0] if said else "", said[1] if len(said) > 1 else "")
    return list(out.values())


def lines(node: Node) -> list[str]:
    """The node's text, parted at line breaks and blocks, blanks left out."""
    out, stack = [""], list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out[-1] += n
        else:
            if n.tag in ("br", "p", "div", "li"):
                out.append("")
            stack += reversed(n.children)
    return [x for x in (re.sub(r"\s+", " ", s).strip() for s in out) if x]


def portfolio(html: str | None, mode: str = "card") -> list[tuple[str, str, str, int | None]]:
    """H6 (T25): (company, stage, url, year). "card": cards up to 1000 characters with any heading, last year named;
    "strict": up to 500 with exactly one heading, greatest year. Below five companies logos, then outside links count too."""
    tree, out = parse(html), {}
    limit = 1000 if mode == "card" else 500

    def add(name: str, text: str = "", url: str = "") -> None:
        name = re.sub(r"\s+", " ", name).strip().rstrip(".,;:!?")
        if 2 <= len(name) <= 80 and len(name.split()) <= 10 and sum(c.isdigit() for c in name) * 2 <= len(name) and name.lower() not in out:
            found = [int(y) for y in re.findall(r"\b(20[0-2]\d)\b", text)]
            stage = next((s for s in ("pre-seed", "seed", "series a", "series b", "series c", "growth") if s in text.lower()), "")
            out[name.lower()] = (name, stage, url, (found[-1] if mode == "card" else max(found)) if found else None)

    for card in tree.find("div", "li", "article"):
        heads, text = [n for n in card.walk() if n.tag in HEADINGS], card.text()
        if heads and len(text) <= limit and (mode == "card" or len(heads) == 1):
            add(heads[0].text(), text, next((a.attrs.get("href", "") for a in card.find("a")), ""))
    if len(out) < 5:
        for n in tree.find("img"):
            add(re.sub(r"\s*logo\s*$", "", n.attrs.get("alt", ""), flags=re.I))
    if len(out) < 5:
        for a in tree.find("a"):
            if a.attrs.get("href", "").startswith("http"):
                add(a.text(), "", a.attrs["href"])
    return list(out.values())


def posts(html: str | None, most: int = 20) -> list[tuple[str, str, bool]]:
    """H7, H8: (title, url, is about an investment) of the page's articles, at most `most`."""
    out = []
    for n in parse(html).find("article", "li", "div"):
        heads = [h for h in n.walk() if h.tag in HEADINGS]
        if len(heads) == 1 and (title := heads[0].text()) and title not in [t for t, _, _ in out]:
            out.append((title, next((a.attrs.get("href", "") for a in n.find("a")), ""), any(v in title.lower() for v in INVEST)))
    return out[:most]


def blocks(html: str | None) -> list[tuple[int, str, str]]:
    """H4: (position, tag, text) of the title, headings and paragraphs."""
    found = [n for n in parse(html).walk() if n.tag in HEADINGS or n.tag in ("title", "p", "li")]
    return [(i, n.tag, t) for i, n in enumerate(found) if (t := n.text())]


SHAPES = {
    "team": (team, "name string, role string, email string, linkedin string"),
    "portfolio": (portfolio, "company string, stage string, url string, year int"),
    "posts": (posts, "title string, url string, is_investment boolean"),
    "blocks": (blocks, "pos int, tag string, text string"),
}


def records(pages: DataFrame, kind: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each record of that kind on each page. Batches stream; a page is parsed once."""
    read, schema = SHAPES[kind]
    out = T.StructType([pages.schema[key], *T._parse_datatype_string(schema).fields])

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = [(k, *r) for k, h in zip(p[key], p[html]) for r in read(h)]
            if rows:
                yield pd.DataFrame(rows, columns=out.names).astype({f.name: "Int32" for f in out.fields if f.dataType == T.IntegerType()})

    return pages.select(key, html).mapInPandas(run, out)


def meta(html: Column) -> Column:
    """H3: map of lower-case name or property to content, the first of each."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0))
    name = lambda t: F.lower(F.coalesce(F.nullif(F.regexp_extract(t, r'(?i)\bproperty="([^"]*)"', 1), F.lit("")), F.regexp_extract(t, r'(?i)\bname="([^"]*)"', 1)))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(name(t).alias("k"), F.regexp_extract(t, r'(?i)\bcontent="([^"]*)"', 1).alias("v"))), lambda x: (x["k"] != "") & (x["v"] != ""))
    first = F.filter(pairs, lambda x, i: F.coalesce(F.array_position(F.transform(F.slice(pairs, F.lit(1), i), lambda y: y["k"]), x["k"]), F.lit(0)) == 0)
    return F.map_from_entries(first)


def links(html: Column) -> Column:
    """Array of (url, label) of the page's links."""
    tags = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r'(?i)href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), r"\s+", " ")).alias("label")))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def profile_urls(html: Column) -> Column:
    """Distinct profile links without query, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(PROFILE_URL), F.lit(0)), lambda u: F.rtrim(F.lower(u), F.lit("/")))))


# Whose name a registry answer gives, and addresses that aren't a person's.
OWNER_PREFIXES = ("Registrant Organization:", "Registrant Name:", "org-name:", "owner:", "Organization:")
REGISTRY_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
REGISTRY_REFUSED = r"(?i)redacted|privacy|protected|noreply|abuse|hostmaster|postmaster|example\.com|icann\.org|iana\.org"


def whois(text: Column) -> Column:
    """Of a registry answer the first owner's name that is given and not redacted, its distinct addresses in order but for
    the registry's own and redacted ones, and the first of them."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")
    value = lambda x: F.trim(F.regexp_extract(x, rf"(?i)^\s*(?:{'|'.join(OWNER_PREFIXES)})(.*)$", 1))
    named = F.filter(F.transform(lines, value), lambda v: (F.length(v) > 2) & ~F.contains(F.upper(v), F.lit("REDACTED")))
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REGISTRY_EMAIL), F.lit(0)), lambda e: F.btrim(F.lower(e), F.lit(".")))
    emails = F.array_distinct(F.filter(found, lambda e: ~F.regexp_like(e, F.lit(REGISTRY_REFUSED))))
    return F.struct(F.get(named, F.lit(0)).alias("name"), emails.alias("emails"), F.get(emails, F.lit(0)).alias("email"))


def registry_contacts(answers: DataFrame) -> DataFrame:
    """One contact a domain of registry answers (domain, answer) that have an address, its name the owner's or the domain."""
    w = answers.select("domain", whois(F.col("answer")).alias("w")).where("w.email is not null")
    return w.groupBy("domain").agg(F.max_by("w", F.struct("w.email", "w.name")).alias("w")).select("domain", F.coalesce("w.name", "domain").alias("name"), F.col("w.email").alias("email"), F.concat(F.lit("https://"), "domain").alias("website"))


def result_urls(html: Column, param: str = "uddg") -> Column:
    """Target addresses of a result page's redirecting links."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"[?&]{param}=([^&\"']+)"), F.lit(1)), F.url_decode)
