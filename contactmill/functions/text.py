"""Cleaning, normalising and recognising text, as Column to Column functions.

All are built-in expressions. Unicode decompositions, which Spark lacks, are tables made from the standard library when first asked
for, and applied by `translate`. Missing values are null here; `blank` maps the usual spellings of a missing value to null.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLANKS = ("", "n/a", "n/a (invalid)", "unknown", "none", "null")
TITLES = ("dr.", "dr ", "mr.", "mr ", "mrs.", "mrs ", "ms.", "ms ", "prof.")
CREDENTIALS = (" jr.", " jr", " sr.", " sr", " iii", " iv", " ii", " esq.", " esq", " ph.d.", " phd", " md", " m.d.", " cfa")
FUND_SUFFIXES = (" ventures", " capital", " partners", " fund", " management", " advisors", " group", " co.", " llc", " lp", " inc.")
SALUTATIONS = ("Meet ", "About ", "Dr. ", "Prof. ")
COMPANY_WORDS = (
    "capital", "ventures", "partners", "fund", "group", "holdings", "management", "investments", "equity", "advisors", "advisory", "associates", "foundation", "institute", "accelerator",
    "incubator", "llc", "inc", "corp", "ltd", "limited", "gmbh", "sa", "ag", "seed", "series", "portfolio", "companies", "company", "growth", "emerging", "strategic", "continuity", "labs",
    "studio", "studios", "platform", "sciences", "technologies", "technology", "digital", "global", "international", "development", "research", "innovation", "catalyst", "operating",
    "team", "meet", "about", "join", "alumni", "network", "community", "program", "programs", "scout", "scouts", "leadership", "board", "blog", "press", "media", "news", "contact", "apply",
    "subscribe", "follow", "visit", "learn", "read", "view", "more", "twitter", "linkedin", "facebook", "instagram", "youtube", "cookies", "cookie", "functional", "performance",
    "targeting", "marketing", "privacy", "overview", "principles", "core", "history", "resources", "navigation", "submission", "submissions", "shared", "values", "philosophy", "customers",
    "colleagues", "communities", "startups", "information", "connect", "links", "help", "select", "sign", "check", "bio", "life", "games", "start", "path", "next", "fundamentals",
    "availability", "activity", "putting", "challenging", "convention", "smarter", "together", "humbly", "day", "demo",
)
STAGES = (
    ("pre-seed", "Pre-Seed"), ("preseed", "Pre-Seed"), ("seed", "Seed"), ("series a", "Series A"), ("series b", "Series B"), ("series c", "Series C"), ("series d", "Series D"), ("series e", "Series E"),
    ("growth", "Growth"), ("late stage", "Late Stage"), ("late-stage", "Late Stage"), ("early stage", "Early Stage"), ("early-stage", "Early Stage"), ("ipo", "IPO"), ("public", "Public"), ("acquired", "Acquired"), ("exited", "Exited"),
)
NOT_COMPANIES = (
    "portfolio", "companies", "investments", "our portfolio", "back to top", "learn more", "read more", "view all", "see all", "load more", "contact us", "about us",
    "privacy policy", "terms of service", "cookie policy", "home", "blog", "news", "team", "careers",
)
TITLE_SCORES = (
    ("founding partner", 100), ("founder & partner", 100), ("co-founder", 95), ("general partner", 95), ("managing partner", 90), ("senior partner", 85), ("managing director", 80), ("partner", 75), ("venture partner", 70),
    ("operating partner", 65), ("director", 60), ("principal", 55), ("vice president", 50), ("vp", 50), ("senior associate", 40), ("associate", 30), ("analyst", 20), ("platform", 15), ("operations", 15), ("talent", 10), ("marketing", 10),
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,15}"
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NOT_EMAILS = (".png", ".jpg", ".svg", ".gif", ".css", ".js", "example.com", "email.com", "domain.com", "sentry.io", "wixpress", "sentry-next")
LEGAL = r"(?i)\b(llc|lp|l\.p\.|ltd|limited|inc|corp|fund\s+[ixv]+|fund\s+\d+|gp|llp|plc|co\.?)\b"
DOMAIN_ENDS = (".com", ".vc", ".co", ".capital", ".ventures", ".fund", ".io")
DATE_FORMS = (
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{4}[/\-]\d{2}[/\-]\d{2}\b",
)
YEAR = r"\b(20[0-2]\d)\b"
CHECK_FORMS = (
    r"(?i)(?:checks?(?:\s*sizes?)?|invest(?:ment)?s?)\s*(?:of|from|between|ranging)?\s*\$?([\d.]+[MmKk]?)\s*(?:to|[-–])\s*\$?([\d.]+[MmKk]?)",
    r"(?i)\$([\d.]+[MmKk]?)\s*(?:to|[-–])\s*\$([\d.]+[MmKk]?)\s*(?:check|investment|initial)",
    r"(?i)(?:up to|typically|average)\s+\$?([\d.]+[MmKk]?)\s*(?:per|check|investment)",
)
ROLE_NOISE = (r"Based\s+In\s*", r"Specialty\s*", r"Specialists?\s*", r"Focus\s*", r"Location\s*", r"Office\b\s*:?\s*", r"Region\s*")
ROLE_PLACES = (
    "Bay Area", "San Francisco", "New York", "Palo Alto", "Boston", "London", "Berlin", "Tel Aviv", "Singapore", "Beijing", "Shanghai",
    "Los Angeles", "Chicago", "Austin", "Seattle", "Menlo Park", "Mountain View", "Toronto", "Mumbai", "Bangalore", "Bengaluru",
)
PLACE_FORMS = (
    r"(?i)(?:based|headquartered|located|offices?)\s+in\s+([A-Z][a-zA-Z\s,]+?)(?:\.|,\s*(?:with|and)|$)",
    r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)?,\s*(?:CA|NY|MA|TX|IL|WA|CO|GA|FL|PA|CT|DC|VA))\b",
    r"(?i)\b(San Francisco|New York|Boston|Los Angeles|Chicago|Seattle|Austin|Miami|Denver|Palo Alto|Menlo Park|Mountain View)\b",
)


def blank(c: Column) -> Column:
    """The trimmed text, or null for any spelling of a missing value."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*BLANKS), t)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def first_of(*options: Column) -> Column:
    """The first option that is neither null nor blank."""
    return F.coalesce(*[blank(o) for o in options])


_HANGUL, _JAMO = (0xAC00, 0xD7A3), (0x1100, 0x1161, 0x11A7)


@cache
def _unmarked() -> tuple[str, str, dict[str, str]]:
    """What each character is without its combining marks: letters and what replaces them, marks (replaced by nothing) last,
    and the few that become several characters. Hangul syllables, which do too, follow a rule of their own."""
    one: dict[str, str] = {}
    gone, several = [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c) == "Mn":
            gone.append(c)
        elif unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(plain) == 1 and plain != c:
                one[c] = plain
            elif len(plain) != 1:
                several[c] = plain
    return "".join(one) + "".join(gone), "".join(one.values()), several


@cache
def _spelt() -> tuple[str, str, dict[str, str]]:
    """The letters a to z that each character outside ASCII has in its compatibility form, in the same three parts; all characters
    without any are left as they are."""
    one, several = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower() if "a" <= x <= "z")
            if len(plain) == 1:
                one[c] = plain
            elif plain:
                several[c] = plain
    return "".join(one), "".join(one.values()), several


def _letter_by_letter(c: Column, several: dict[str, str], hangul: bool = False) -> Column:
    """The text with characters replaced by several others; texts that hold none aren't taken apart."""
    table = F.create_map(*[x for k, v in several.items() for x in (F.lit(k), F.lit(v))]) if several else None
    rare = "".join(f"\\x{{{ord(k):x}}}" for k in several) + (f"\\x{{{_HANGUL[0]:x}}}-\\x{{{_HANGUL[1]:x}}}" if hangul else "")
    if not rare:
        return c

    def spelt(x: Column) -> Column:
        out = F.coalesce(F.element_at(table, x), x) if several else x
        if not hangul:
            return out
        n = F.ascii(x) - _HANGUL[0]
        jamo = lambda at, count, start: F.substring(F.lit("".join(chr(start + i) for i in range(count))), at + 1, F.lit(1))
        last = F.when(n % 28 > 0, jamo(n % 28, 28, _JAMO[2])).otherwise("")
        syllable = F.concat(jamo(F.floor(n / 588).cast("int"), 19, _JAMO[0]), jamo(F.floor(n % 588 / 28).cast("int"), 21, _JAMO[1]), last)
        return F.when((n >= 0) & (n <= _HANGUL[1] - _HANGUL[0]), syllable).otherwise(out)

    return F.when(F.regexp_like(c, F.lit(f"[{rare}]")), F.array_join(F.transform(F.split(c, ""), spelt), "")).otherwise(c)


def strip_marks(c: Column) -> Column:
    """Canonical decomposition without its combining marks (é to e)."""
    letters, plain, several = _unmarked()
    return F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7F]")), F.translate(_letter_by_letter(c, several, hangul=True), letters, plain)).otherwise(c)


def ascii_letters(c: Column) -> Column:
    """Compatibility decomposition, lower case, only a to z."""
    letters, plain, several = _spelt()
    lower = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spelt = F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7F]")), F.translate(_letter_by_letter(lower, several), letters, plain)).otherwise(lower)
    return F.regexp_replace(spelt, "[^a-z]", "")


def _cut_start(c: Column, options: tuple[str, ...], fold: bool = True) -> Column:
    """Cut each option in turn off the start, trimmed after each cut; a fold, so the expression stays small."""
    rest = lambda a, o: F.substr(a, F.length(o) + 1)
    return F.aggregate(F.array(*map(F.lit, options)), c, lambda a, o: F.when(F.startswith(a, o), F.trim(rest(a, o)) if fold else rest(a, o)).otherwise(a))


def _cut_end(c: Column, options: tuple[str, ...]) -> Column:
    """Cut each option in turn off the end, trimmed after each cut."""
    return F.aggregate(F.array(*map(F.lit, options)), c, lambda a, o: F.when(F.endswith(a, o), F.trim(F.left(a, F.length(a) - F.length(o)))).otherwise(a))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def normalize_name_plain(c: Column) -> Column:
    """P1 without the decomposition: for text without accents, or already stripped."""
    n = _cut_end(_cut_start(F.trim(F.lower(F.coalesce(c, F.lit("")))), TITLES), CREDENTIALS)
    parts = words(n)
    letter = lambda p: F.regexp_like(p, F.lit(r"^\p{L}\.?$"))
    return F.array_join(F.when(F.size(parts) > 2, F.filter(parts, lambda p: ~letter(p))).otherwise(parts), " ")


def normalize_name(c: Column) -> Column:
    """Accents, titles, credentials and middle initials gone; lower case; null is empty."""
    return normalize_name_plain(strip_marks(c))


def normalize_fund(c: Column) -> Column:
    """Lower case, each suffix tried once, in order."""
    return _cut_end(F.trim(F.lower(F.coalesce(c, F.lit("")))), FUND_SUFFIXES)


def merge_key(name: Column, fund: Column) -> Column:
    """P3 over names that are already normalised."""
    return F.md5(F.concat_ws("|", name, fund))


def clean_person_name(c: Column) -> Column:
    """Salutations and closing dots gone."""
    return F.trim(F.rtrim(_cut_start(F.trim(c), SALUTATIONS, fold=False), F.lit(".")))


def is_person_name(c: Column) -> Column:
    """P5: two to five words, none of a company, not all capitals beyond two words, no digit."""
    t = F.rtrim(_cut_start(F.trim(c), SALUTATIONS, fold=False), F.lit("."))
    ws = words(F.lower(t))
    company = F.exists(ws, lambda w: F.rtrim(w, F.lit(".,;:")).isin(*COMPANY_WORDS))
    shout = (t == F.upper(t)) & (F.size(ws) > 2)
    return F.coalesce(blank(c).isNotNull() & F.size(ws).between(2, 5) & ~company & ~shout & ~F.regexp_like(t, F.lit(r"\d")), F.lit(False))


def looks_like_company(c: Column) -> Column:
    """2 to 80 characters, no navigation text, at most half digits and ten words."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.coalesce(F.length(c).between(2, 80) & ~F.lower(c).isin(*NOT_COMPANIES) & (digits * 2 <= F.length(c)) & (F.size(words(c)) <= 10), F.lit(False))


def clean_company_name(c: Column) -> Column:
    return F.rtrim(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(".,;:!?"))


def host(c: Column) -> Column:
    """P10: network location in lower case, one leading www. gone; a scheme is not needed; null if there is none."""
    h = F.lower(F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def host_loose(c: Column) -> Column:
    """Like `host`, with www. removed wherever it stands."""
    h = F.lower(F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)", 1))
    return F.nullif(F.replace(h, F.lit("www."), F.lit("")), F.lit(""))


def base_url(c: Column) -> Column:
    """Scheme and network location."""
    return F.nullif(F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.lit(""))


def url_path(c: Column) -> Column:
    """Path in lower case without slashes at its ends."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)), "^/+|/+$", "")


def domain_candidates(c: Column) -> Column:
    """Possible domains of a fund's name, best first: two spellings by seven endings; none for short names."""
    name = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, LEGAL, "")), r"""[,.'"!?()&@]""", ""))
    ws = words(F.lower(name))
    slug = lambda sep: F.trim(F.regexp_replace(F.array_join(ws, sep), "^-+|-+$", ""))
    ends = F.array(*map(F.lit, DOMAIN_ENDS))
    both = F.array_distinct(F.concat(F.transform(ends, lambda e: F.concat(slug(""), e)), F.transform(ends, lambda e: F.concat(slug("-"), e))))
    return F.when(F.length(slug("")) >= 4, both).otherwise(F.expr("cast(array() as array<string>)"))


def email_ok(c: Column) -> Column:
    """The format of an address, trimmed and lower-cased."""
    return F.coalesce(F.regexp_like(F.lower(F.trim(c)), F.lit(EMAIL_FORMAT)), F.lit(False))


def clean_email(c: Column) -> Column:
    """Text glued to either end of an address cut off; lower case."""
    local, domain = F.regexp_extract(c, r"^(.*)@[^@]*$", 1), F.regexp_extract(c, r"@([^@]*)$", 1)
    short = F.regexp_replace(local, r"^(?:[A-Z][a-zA-Z]*|\d+[A-Z][a-zA-Z]*)(?=[a-z])", "")
    local = F.when(short == "", local).otherwise(short)
    base, tld = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"\.([^.]*)$", 1)
    tld = F.regexp_replace(tld, r"(?<=[a-z])(?=[A-Z]).*$", "")
    tld = F.when(F.length(tld) > 15, F.left(tld, F.lit(3))).otherwise(tld)
    return F.lower(F.when(F.contains(domain, F.lit(".")), F.concat(local, F.lit("@"), base, F.lit("."), tld)).otherwise(F.concat(local, F.lit("@"), domain)))


def emails(c: Column) -> Column:
    """Distinct addresses in a text, cleaned and sorted; file names and placeholders left out."""
    none = F.expr("cast(array() as array<string>)")
    found = F.transform(F.when(F.contains(c, F.lit("@")), F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))).otherwise(none), clean_email)
    bad = lambda e: F.exists(F.array(*map(F.lit, NOT_EMAILS)), lambda x: F.contains(e, x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: ~bad(e))))


def emails_in_html(c: Column) -> Column:
    """Addresses of links, attributes, plain and obfuscated text, 5 to 60 characters."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)\s*[\[\(\{]\s*at\s*[\]\)\}]\s*", "@"), r"(?i)\s*[\[\(\{]\s*dot\s*[\]\)\}]\s*", ".")
    return F.filter(F.array_sort(F.array_union(emails(c), F.array_union(emails(plain), emails(F.regexp_replace(c, "&#64;|&commat;|%40", "@"))))), lambda e: F.length(e).between(5, 60))


def email_name_score(email: Column, first: Column, last: Column) -> Column:
    """How well an address fits a person, 0 to 1, by the shape of its local part."""
    local, f = F.lower(F.substring_index(email, "@", 1)), F.left(first, F.lit(1))
    rules = [
        (F.concat(first, F.lit("."), last), 1.0), (first, 0.8), (F.concat(first, last), 0.9), (F.concat(f, last), 0.85), (F.concat(f, F.lit("."), last), 0.85),
        (last, 0.6), (F.concat(first, F.lit("_"), last), 0.9), (F.concat(last, F.lit("."), first), 0.8),
    ]
    out = F.when((F.coalesce(first, F.lit("")) == "") | (F.coalesce(last, F.lit("")) == ""), 0.0)
    for shape, score in rules:
        out = out.when(local == shape, score)
    has = lambda x: F.contains(local, x)
    return out.when(has(first) & has(last), 0.7).when(has(first), 0.4).when(has(last), 0.5).otherwise(0.0)


def detect_stage(c: Column) -> Column:
    """Label of the first keyword, in order, that the text contains; else empty."""
    low, out = F.lower(c), None
    for key, label in STAGES:
        out = (F if out is None else out).when(F.contains(low, F.lit(key)), label)
    return out.otherwise("")


def years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def last_year(c: Column) -> Column:
    """P23, first variant: the last year named."""
    return F.get(F.reverse(years(c)), F.lit(0))


def latest_year(c: Column) -> Column:
    """P23, second variant: the greatest year named."""
    return F.array_max(years(c))


def dates(c: Column) -> Column:
    """Date-like strings, form by form."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in DATE_FORMS])


def keyword_counts(c: Column, buckets: dict[str, list[str]]) -> Column:
    """P25: map of bucket to its number of keywords in the text, buckets without any left out."""
    low = F.lower(c)
    pairs = [x for b, ks in buckets.items() for x in (F.lit(b), sum((F.contains(low, F.lit(k.lower())).cast("int") for k in ks), F.lit(0)))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def check_amounts_compat(c: Column) -> Column:
    """P26 as it always was: K and M become zeros before numbers are read, so $1.5M is 1 and 5000000."""
    t = F.replace(F.replace(c, F.lit("K"), F.lit("000")), F.lit("M"), F.lit("000000"))
    found = F.regexp_extract_all(t, F.lit(r"[\d,]+"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(",")).cast("long"))


def check_amounts(c: Column) -> Column:
    """P26 done right: decimals and k or m in either case."""
    found = F.regexp_extract_all(F.replace(c, F.lit(",")), F.lit(r"(?i)\d+(?:\.\d+)?\s*[km]?"), F.lit(0))
    unit = lambda x: F.when(F.endswith(F.lower(x), F.lit("k")), 1000).when(F.endswith(F.lower(x), F.lit("m")), 1_000_000).otherwise(1)
    return F.transform(found, lambda x: F.round(F.regexp_extract(x, r"^[\d.]+", 0).cast("double") * unit(x)).cast("long"))


def first_match(c: Column, forms: tuple[str, ...]) -> Column:
    """The first form that matches, whole match; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in forms])


def title_score(c: Column) -> Column:
    """The greatest score of the titles contained, else 0."""
    low = F.lower(c)
    return F.greatest(*[F.when(F.contains(low, F.lit(k)), v).otherwise(0) for k, v in TITLE_SCORES])


def content_hash(c: Column) -> Column:
    """16 hex digits that don't change with scripts, styles, tags, case or white space."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.left(F.sha2(F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))), 256), F.lit(16))


def split_name(c: Column) -> tuple[Column, Column]:
    """First name and the rest."""
    parts = F.split(F.trim(c), r"\s+", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def usable_email(c: Column) -> Column:
    """The first word, if it has an @ and isn't marked invalid; else null."""
    first = F.get(words(c), F.lit(0))
    return F.when(F.contains(c, F.lit("@")) & ~F.contains(F.lower(c), F.lit("invalid")), first)


def role_text(c: Column) -> Column:
    """Words of camel case parted, page noise and places cut out, white space collapsed; null below 3 characters."""
    t = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    for noise in ROLE_NOISE:
        t = F.regexp_replace(t, f"(?i){noise}", " ")
    # None of the places is within another, so one pass is as many.
    t = F.regexp_replace(t, f"(?i){'|'.join(ROLE_PLACES)}", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) >= 3, t)


def place(c: Column, blocks: Column | None = None) -> Column:
    """A place: of the page's JSON-LD blocks (an array of JSON texts) the first address, else what the first form that
    matches names; null if none."""

    def address(block: Column) -> Column:
        """City and region, or a short text; null where the block has neither."""
        get = lambda path: F.get_json_object(block, f"$.address{path}")
        city, region, whole = F.nullif(get(".addressLocality"), F.lit("")), F.nullif(get(".addressRegion"), F.lit("")), get("")
        plain = ~F.startswith(whole, F.lit("{")) & ~F.startswith(whole, F.lit("[")) & (F.length(whole) < 100)
        return F.when(city.isNotNull(), F.concat_ws(", ", city, region)).when(plain, whole)

    found = F.coalesce(*[F.nullif(F.rtrim(F.trim(F.regexp_extract(c, p, 1)), F.lit(",")), F.lit("")) for p in PLACE_FORMS])
    if blocks is None:
        return found
    first = F.get(F.filter(F.transform(blocks, address), lambda x: x.isNotNull()), F.lit(0))
    return F.when(first.isNotNull(), F.nullif(first, F.lit(""))).otherwise(found)


def reject_email(c: Column, ignore: tuple[str, ...], domain: Column | None = None) -> Column:
    """P20: whether an address is unwanted: an ignored part, an odd length, or another domain than the one asked for."""
    bad = ~F.length(c).between(5, 60) | F.exists(F.array(F.lit(""), *map(F.lit, ignore)), lambda x: (x != "") & F.contains(F.lower(c), x))
    return bad if domain is None else bad | (F.lower(F.substring_index(c, "@", -1)) != domain)


# Words and phrases that tell investors, their firms and their boards.
MANAGER_WORDS = ("capital", "ventures", "partners", "equity", "fund", "growth", "management", "advisors", "holdings", "associates", "investment")
SPEAKER_ROLES = ("partner", "managing", "general partner", "gp", "principal", "venture", "investor", "director", "founder", "ceo", "president", "chairman", "managing director", "md", "operating partner", "venture partner", "investment", "portfolio", "fund manager")
SPEAKER_FIRMS = ("capital", "ventures", "partners", "vc", "fund", "equity", "growth", "investment", "holdings", "advisors", "management", "associates")
BIO_WORDS = ("venture", "investor", "vc", "capital", "portfolio", "fund", "partner at", "investing in", "seed stage", "series a", "angel", "limited partner", "general partner")
BIO_FUND = r"(?i)(?:partner|managing director|gp|general partner|principal|investor|founder|ceo|venture partner|operating partner)\s+(?:at|@|of|,)\s+([A-Z][A-Za-z\s&\-]+(?:Capital|Ventures|Partners|Fund|VC|Equity|Growth|Management|Advisors|Holdings|Associates|Group))"
BOARD_PHRASES = ("board seat", "board member", "board director", "board of directors", "sits on the board", "joins the board", "board observer")
FUND_WORDS = ("capital", "ventures", "partners", "fund", "vc", "holdings", "group", "advisors", "investments", "management", "equity", "labs")
LED_BY = r"(?i)(?:led by|with participation from|joined by|co-led by|backed by|investors? include)\s+([A-Z][A-Za-z\s&,]+(?:Capital|Ventures|Partners|Fund|VC|Holdings|Group|Advisors|Investment[s]?))"
TEAM_PATHS = ("team", "people", "about", "who-we-are", "our-team", "partners", "leadership", "staff", "investors", "bios", "professionals", "contact", "connect", "reach-out", "get-in-touch", "management", "executives", "board", "advisors", "advisory", "principals", "firm", "managing-directors", "founders", "bio", "profiles", "directory", "roster", "meet-us")


def any_part(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text, in lower case, contains one of the parts."""
    return F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(c), p)), F.lit(False))


def is_manager_name(c: Column) -> Column:
    """A word of the name is one that managers' names have."""
    return F.coalesce(F.exists(words(F.lower(c)), lambda w: w.isin(*MANAGER_WORDS)), F.lit(False))


def manager_name(c: Column) -> Column:
    """The fund's number and legal form cut off its end."""
    n = F.regexp_replace(F.trim(c), r"\s+(I{1,3}V?|V|VI{0,3}|[0-9]+)\s*$", "")
    return F.trim(F.btrim(F.regexp_replace(n, r"(?i)\s+(LP|LLC|L\.P\.?|Ltd\.?)\s*$", ""), F.lit(" .,")))


def is_investor_speaker(role: Column, company: Column) -> Column:
    """Role or company of a speaker tells an investor."""
    return any_part(F.concat_ws(" ", role, company), SPEAKER_ROLES + SPEAKER_FIRMS)


def bio_fund(c: Column) -> Column:
    """The fund that a text names behind a role; null if none."""
    return F.nullif(F.trim(F.regexp_extract(c, BIO_FUND, 1)), F.lit(""))


def led_by(c: Column) -> Column:
    """Funds that an announcement names as investors."""
    return let(F.regexp_extract(c, LED_BY, 1), split_funds)


def split_funds(c: Column) -> Column:
    """Names of a list joined by commas or "and": such with a fund's word, or of two capitalised words or more."""
    parts = F.transform(F.split(F.regexp_replace(c, r"(?i)\band\b", ","), ","), lambda p: F.trim(F.rtrim(F.trim(p), F.lit("."))))

    def fund(p: Column) -> Column:
        ws = F.split(p, r"\s+")
        proper = (F.size(ws) >= 2) & F.forall(ws, lambda w: (F.length(w) <= 2) | F.regexp_like(w, F.lit(r"^\p{Lu}")))
        return (F.length(p) >= 3) & (proper | F.exists(ws, lambda w: F.lower(w).isin(*FUND_WORDS)))

    return F.filter(parts, fund)


def is_team_path(url: Column) -> Column:
    """Whether an address may be a team's page."""
    return any_part(url_path(url), TEAM_PATHS)


def board_signals(home: Column, bios: Column, news: Column, most: int = 5) -> Column:
    """Mentions of board seats, at most five: on the homepage each phrase; of members (name, bio) and of the first ten
    news items (headline, snippet) the first phrase."""
    phrases = F.array(*map(F.lit, BOARD_PHRASES))
    said = lambda c: F.filter(phrases, lambda p: F.contains(F.lower(c), p))
    quote = lambda head, p: F.concat(head, F.lit(" mentions '"), p, F.lit("'"))
    first = lambda items, body, head: F.filter(F.transform(items, lambda x: quote(head(x), F.get(said(body(x)), F.lit(0)))), lambda s: s.isNotNull())
    a = F.transform(said(F.coalesce(home, F.lit(""))), lambda p: quote(F.lit("homepage"), p))
    b = first(bios, lambda m: m["bio"], lambda m: F.concat(m["name"], F.lit(" bio")))
    c = first(F.slice(news, 1, 10), lambda n: F.concat_ws(" ", n["headline"], n["snippet"]), lambda n: F.concat(F.lit("news: '"), F.left(n["headline"], F.lit(50)), F.lit("'")))
    return F.slice(F.concat(a, b, c), 1, most)


def derived_status(status: Column, email: Column, verified: Column, source: Column) -> Column:
    """An unknown status from what else is known of the address."""
    v = F.coalesce(verified, F.lit(False))
    known = F.when(blank(email).isNull(), "unknown").when(source == "scraped", "scraped").when(v, "verified").when(source.isin("guessed", "pattern"), "guessed").otherwise("unknown")
    return F.when(F.coalesce(status, F.lit("unknown")) == "unknown", known).otherwise(status)


def not_fund_row(name: Column, fund: Column) -> Column:
    """A row of a person: its name isn't its fund's."""
    return F.lower(F.trim(F.coalesce(name, F.lit("")))) != F.lower(F.trim(F.coalesce(fund, F.lit(""))))
