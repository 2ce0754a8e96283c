"""Sources (S1 to S27): files and text columns to lead rows. No network; what was fetched comes in as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.functions import text as t
from contactmill.operators.dedupe import first_wins

LEAD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("name", "email", "role", "fund")]
    + [T.StructField("focus_areas", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("stage", "check_size", "location", "linkedin", "website", "source")]
    + [T.StructField("scraped_at", T.TimestampType()), T.StructField("lead_score", T.IntegerType()), T.StructField("tier", T.StringType()), T.StructField("email_status", T.StringType())]
)

#: Header candidates of a list, best first, and the keys under which a JSON list may lie.
HEADERS = {
    "name": ("name", "firm", "fund", "investor", "company"),
    "website": ("website", "url", "site", "domain", "link"),
    "location": ("location", "hq", "city", "country"),
    "stage": ("stage",),
    "focus_areas": ("focus", "sector", "industry"),
    "check_size": ("check", "ticket"),
}
LIST_KEYS = ("firms", "investors", "funds", "data", "results", "items")
FORM_D = ("D", "D/A")


def as_leads(df: DataFrame) -> DataFrame:
    """All lead columns, in order; those that a source lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEAD], *[c for c in df.columns if c in ("seq", "source_rank")])


def split_list(c: Column) -> Column:
    """Areas by | where there is one, else by white space; blanks out."""
    return F.filter(F.transform(F.when(F.contains(c, F.lit("|")), F.split(c, r"\|")).otherwise(F.split(c, r"\s+")), lambda x: F.trim(x)), lambda x: x != "")


def seed_union(frames: list[tuple[str, DataFrame]], focus: dict[str, str], location: dict[str, str]) -> DataFrame:
    """Seed tables of different dialects as leads; first file wins by lower-cased name."""
    out = None
    for rank, (stem, df) in enumerate(frames):
        f, loc = focus.get(stem, "focus_areas"), location.get(stem, "location")
        have = lambda c: F.trim(F.col(c)) if c in df.columns else F.lit(None).cast("string")  # noqa: B023, E731
        rows = df.select(have("name").alias("name"), have("name").alias("fund"), split_list(have(f)).alias("focus_areas"), have("stage").alias("stage"), have("check_size").alias("check_size"), have(loc).alias("location"), have("website").alias("website"), F.lit(f"seed:{stem}").alias("source"), F.lit(rank).alias("source_rank"))
        rows = rows.where(t.blank(F.col("name")).isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return as_leads(first_wins(out.withColumn("_n", F.lower("name")), ["_n"], "source_rank", "name").drop("_n"))


def read_seeds(spark: SparkSession, paths: dict[str, str], **dialects: dict[str, str]) -> DataFrame:
    """S1 over CSV files by stem."""
    return seed_union([(stem, spark.read.csv(p, header=True)) for stem, p in paths.items()], dialects.get("focus", {}), dialects.get("location", {}))


def pick_headers(columns: list[str]) -> dict[str, str]:
    """Which column serves each lead field: the first candidate contained in a header."""
    out: dict[str, str] = {}
    for field, options in HEADERS.items():
        for o in options:
            hit = next((c for c in columns if o in c.lower() and c not in out.values()), None)
            if hit:
                out[field] = hit
                break
    return out


def fuzzy_csv(df: DataFrame) -> DataFrame:
    """A table of any header as leads; names of 2 characters or more; https:// before bare sites."""
    use = pick_headers(df.columns)
    if "name" not in use:
        return as_leads(df.limit(0).select(F.lit(None).cast("string").alias("name")))
    cols = {k: F.trim(F.col(f"`{v}`")) for k, v in use.items()}
    if "website" in cols:
        cols["website"] = F.when(F.contains(cols["website"], F.lit("://")) | (cols["website"] == ""), cols["website"]).otherwise(F.concat(F.lit("https://"), cols["website"]))
    if "focus_areas" in cols:
        cols["focus_areas"] = split_list(cols["focus_areas"])
    return as_leads(df.select(*[v.alias(k) for k, v in cols.items()]).where(F.length("name") >= 2))


def json_list(df: DataFrame, column: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """S3: one row for each object of a JSON list, at the top or under a usual key; keys match without case, - and _."""
    arrays = "array<map<string,string>>"
    items = F.coalesce(F.from_json(column, arrays), *[F.from_json(F.get_json_object(column, f"$.{k}"), arrays) for k in LIST_KEYS])
    plain = F.transform_keys(F.col("_m"), lambda k, _: F.regexp_replace(F.lower(k), "[-_]", ""))
    rows = df.select(*[c for c in df.columns if c != column], F.explode(items).alias("_m")).withColumn("_m", plain)
    return rows.select(*[c for c in rows.columns if c != "_m"], *[F.coalesce(*[F.get(F.map_values(_entry(n)), F.lit(0)) for n in names]).alias(f) for f, names in fields.items()])


def _entry(name: str) -> Column:
    return F.map_filter("_m", lambda k, _: k == name)


def markdown_links(df: DataFrame, column: str) -> DataFrame:
    """(name, website) of [name](url); short names, badges and code hosting left out."""
    found = F.regexp_extract_all(column, F.lit(r"\[([^\]]+)\]\((https?://[^)\s]+)\)"), F.lit(0))
    rows = df.select(*[c for c in df.columns if c != column], F.explode(found).alias("_l"))
    rows = rows.withColumns({"name": F.trim(F.regexp_extract("_l", r"^\[([^\]]+)\]", 1)), "website": F.regexp_extract("_l", r"\((https?://[^)\s]+)\)$", 1)}).drop("_l")
    return rows.where((F.length("name") >= 3) & ~F.lower("website").rlike("badge|shields\\.io|github\\.com"))


def numbered_lines(df: DataFrame, column: str) -> DataFrame:
    """Lines of a text column with their place."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(column, "\r?\n")).alias("pos", "line"))


def markdown_table(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, row, cells, header) of the first pipe table of each text; the separator row is passed over."""
    piped = lambda x: F.startswith(F.trim(x), F.lit("|"))
    lines = F.split(column, "\r?\n")
    start = F.array_position(F.transform(lines, piped), True)
    rest = F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: ~piped(x)), True)
    body = F.when(start == 0, F.expr("cast(array() as array<string>)")).when(stop == 0, rest).otherwise(F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = F.filter(body, lambda x: ~F.regexp_like(x, F.lit(r"^[\s|:-]+$")))
    out = df.select(key, rows.alias("_b")).where(F.size("_b") > 1).select(key, cells(F.get("_b", F.lit(0))).alias("header"), F.posexplode(F.slice("_b", F.lit(2), F.size("_b"))).alias("row", "_line"))
    return out.select(key, "row", "header", cells(F.col("_line")).alias("cells"))


def bullets(df: DataFrame, column: str) -> DataFrame:
    """Links of the lines that start with -, * or +."""
    return markdown_links(numbered_lines(df, column).where(F.col("line").rlike(r"^\s*[-*+]\s")), "line")


def company_index(lines: DataFrame, forms: tuple[str, ...] = FORM_D) -> DataFrame:
    """Fixed-width filing index: name, form, cik without leading zeros, date, file."""
    form = r"^(.{62})\s*(\S+)\s+(\d+)\s+(\d{4}-\d{2}-\d{2})\s+(\S+)"
    g = lambda n: F.regexp_extract("value", form, n)
    rows = lines.select(F.trim(g(1)).alias("company"), g(2).alias("form"), F.regexp_replace(g(3), "^0+(?=.)", "").alias("cik"), g(4).cast("date").alias("filed"), g(5).alias("file"))
    return rows.where(F.col("form").isin(*forms))


def newest(filings: DataFrame, n: int) -> DataFrame:
    """The newest filings."""
    return filings.orderBy(F.desc("filed"), "cik", "file").limit(n)


def quarters(first_year: int, last_year: int, as_of: str) -> str:
    """SQL for the (year, quarter) grid without quarters after `as_of`."""
    return f"select y as year, q as quarter from (select explode(sequence({first_year}, {last_year})) as y) lateral view explode(sequence(1, 4)) t as q where make_date(y, 3 * q - 2, 1) <= date'{as_of}'"


OFFICERS = "relatedPersonsList struct<relatedPersonInfo: array<struct<relatedPersonName: struct<firstName: string, lastName: string>, relatedPersonRelationshipList: struct<relationship: array<string>>, relationshipClarification: string>>>, primaryIssuer struct<entityName: string>"


def form_d_people(df: DataFrame, column: str) -> DataFrame:
    """People of Form D documents, namespaces cut off; role by clarification, then relationship, else Principal."""
    doc = F.from_xml(F.regexp_replace(F.regexp_replace(column, r"<(/?)\w+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), OFFICERS)
    rows = df.select(*[c for c in df.columns if c != column], doc.alias("_d")).select("*", F.explode("_d.relatedPersonsList.relatedPersonInfo").alias("_p"))
    roles = F.col("_p.relatedPersonRelationshipList.relationship")
    role = t.first_of(F.col("_p.relationshipClarification"), F.array_join(roles, ", "), F.lit("Principal"))
    out = rows.select(*[c for c in df.columns if c != column], F.concat_ws(" ", F.trim("_p.relatedPersonName.firstName"), F.trim("_p.relatedPersonName.lastName")).alias("name"), F.col("_d.primaryIssuer.entityName").alias("fund"), role.alias("role"))
    return out.where(t.blank(F.col("name")).isNotNull() & (F.lower("role") != "investor"))


def people_lines(df: DataFrame, column: str, key: str, roles: str = r"(?i)\b(partner|principal|director|associate|analyst|founder|managing|president|officer)\b", ahead: int = 3, default: str | None = None) -> DataFrame:
    """Lines of two to four capitalised words with the first role line among the next `ahead`."""
    lines = F.transform(F.split(column, "\r?\n"), lambda x: F.trim(x))
    name = lambda x: F.regexp_like(x, F.lit(r"^\p{Lu}[\p{L}.'-]*(\s+\p{Lu}[\p{L}.'-]*){1,3}$"))
    pos = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: name(F.get("_l", i)) & ~F.regexp_like(F.get("_l", i), F.lit(roles)))
    rows = df.select(key, lines.alias("_l")).select(key, "_l", F.explode(pos).alias("pos"))
    role = F.get(F.filter(F.slice("_l", F.col("pos") + 2, F.lit(ahead)), lambda x: F.regexp_like(x, F.lit(roles))), F.lit(0))
    out = rows.select(key, "pos", F.get("_l", F.col("pos")).alias("name"), (role if default is None else F.coalesce(role, F.lit(default))).alias("role"))
    return out.where("role is not null")


def target_list(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Addresses of a list file, comments and recently seen hosts left out."""
    rows = lines.select(F.trim("value").alias("url")).where("url != '' and not startswith(url, '#')").distinct()
    return rows.withColumn("domain", t.host(F.col("url"))).join(seen.select("domain").distinct(), "domain", "left_anti")


def checkpoint(df: DataFrame) -> DataFrame:
    """A stored table as leads: blanks null, unknown status and score 0 by default, bad times null."""
    rename = {c: c.lower().replace(" ", "_") for c in df.columns}
    rows = df.withColumnsRenamed(rename)
    fix = {c: t.blank(F.col(c)) for c in rows.columns if dict(rows.dtypes)[c] == "string"}
    if "focus_areas" in fix:
        fix["focus_areas"] = F.filter(F.transform(F.split("focus_areas", ";"), lambda x: F.trim(x)), lambda x: x != "")
    if "scraped_at" in fix:
        fix["scraped_at"] = F.try_to_timestamp("scraped_at")
    if "lead_score" in fix:
        fix["lead_score"] = F.coalesce(F.expr("try_cast(lead_score as int)"), F.lit(0))
    rows = as_leads(rows.withColumns(fix))
    return rows.withColumn("email_status", F.coalesce("email_status", F.lit("unknown")))


def cached(df: DataFrame, at: str, as_of: str, days: int = 7) -> DataFrame:
    """Entries of a side table within their time to live."""
    return df.where(F.col(at) > F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))


def valid_domain(host: Column, ignored: tuple[str, ...], ends: tuple[str, ...] = (".gov", ".edu", ".mil")) -> Column:
    """No ignored part, no public ending, no news or blog host."""
    bad = F.exists(F.array(F.lit(" "), *map(F.lit, ignored)), lambda x: F.contains(host, x))
    for e in ends:
        bad = bad | F.endswith(host, F.lit(e))
    return F.coalesce(~bad & ~host.rlike(r"(^|\.)(news|blog)\."), F.lit(False))


def expand_domains(found: list[DataFrame], known: DataFrame) -> DataFrame:
    """Distinct domains of all lists that aren't known."""
    out = found[0].select("domain")
    for f in found[1:]:
        out = out.union(f.select("domain"))
    return out.where("domain is not null").distinct().join(known.select("domain").distinct(), "domain", "left_anti")


def first_existing(names: DataFrame, exists: DataFrame) -> DataFrame:
    """Of each name's candidate domains, in order, the first that exists. `names` has a column `fund`."""
    c = names.select("fund", F.posexplode(t.domain_candidates(F.col("fund"))).alias("pos", "domain"))
    return c.join(exists.select("domain").distinct(), "domain", "left_semi").groupBy("fund").agg(F.min_by("domain", "pos").alias("domain"))


class Registry:
    """Adapters by name: functions from a table of cards to leads, by vertical."""

    def __init__(self) -> None:
        self.all: dict[str, tuple[Callable[[DataFrame], DataFrame], frozenset[str]]] = {}

    def add(self, name: str, *verticals: str) -> Callable:
        def take(f: Callable[[DataFrame], DataFrame]) -> Callable:
            self.all[name] = (f, frozenset(verticals))
            return f

        return take

    def names(self, vertical: str | None = None) -> list[str]:
        return sorted(n for n, (_, v) in self.all.items() if vertical is None or not v or vertical in v)

    def leads(self, cards: DataFrame, name: str) -> DataFrame:
        return as_leads(self.all[name][0](cards)).withColumn("source", F.lit(name)).where("name is not null")


adapters = Registry()


def _card(selectors: dict[str, tuple[str, ...]]) -> Callable[[DataFrame], DataFrame]:
    """Each field from the first selector of a card's map that isn't blank."""
    return lambda cards: cards.select(*[t.first_of(*[F.col("card")[s] for s in names]).alias(field) for field, names in selectors.items()])


# The places of a card where each field may stand, in order.
SELECTORS = {
    "name": ("name", "title", "h3", "h2"), "role": ("role", "position", "subtitle"), "fund": ("fund", "company", "firm"), "location": ("location", "city"), "stage": ("stage", "stages"), "check_size": ("check_size", "check"),
    "linkedin": ("linkedin",), "website": ("website", "url"), "email": ("email",),
}

for _name, _verticals in {"angelmatch": ("vc",), "crunchbase": ("vc", "pe"), "landscape": ("vc",), "openvc": ("vc",), "signal": ("vc",), "visible": ("vc",), "wellfound": ("vc",), "regional": ()}.items():
    adapters.add(_name, *_verticals)(_card(SELECTORS))
