"""Secret scans over a trigram inverted index; DataFrame functions only.

A Boolean query over trigrams is derived from each rule's regular expression: a necessary condition, so that texts which
lack it need no look. The index holds, for every trigram that some query uses, the texts (ASCII case folded) that
contain it. Postings are intersected per document, by OR-ing one bit a trigram, never by gathering a trigram's list, so a
trigram of most documents is no hot key. Candidates are verified by the regular expression on the whole text; only their
texts are looked up, the other columns meet finished spans. A rule without a mandatory trigram scans every text.

A kind's matches are leftmost and do not overlap; those shorter than its limits are dropped after matching. Offsets
count code points, end exclusive. Null text is empty. Ids may be null; documents are told apart by a hash of id and
text, and rows that repeat both share their result. Empty input gives empty output. Other columns pass through; an input
column with the name of an added one is replaced.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small
from .rule_ledger import let


@dataclass(frozen=True)
class Rule:
    """group, least: the group that must have so many characters (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


_NAMES = "|".join(["password", "passwd", "secret", "token", "api_?key"])

#: The kinds, in the order that breaks ties of spans with one start.
RULES: tuple[Rule, ...] = (
    Rule("assign", f"({_either_case(_NAMES)})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("hosting_token", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", "sk_live_[A-Za-z0-9]{16,}"),
    Rule("maps_key", "AIza[A-Za-z0-9_-]{35,}"),
)

ADDED = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
#: Strings that an expression's exact set may have while trigrams are derived.
MOST = 64
#: Candidates, about 80 bytes each, that may be broadcast to find their texts.
BROADCAST_CANDIDATES = 100_000

# A query is None (anything matches) or a set of alternatives, each a frozenset of trigrams that must all occur.
Query = frozenset | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least(frozenset(x | y for x, y in product(a, b)))


def _least(q: frozenset) -> Query:
    """Without alternatives that another one covers; None if there are too many."""
    q = frozenset(x for x in q if not any(y < x for y in q))
    return None if len(q) > MOST or frozenset() in q else q


def _grams(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Query:
    """A necessary condition on the case-folded text of any match."""
    exact, query = _derive(parser.parse(pattern))
    return _both(query, _grams(exact)) if exact is not None else query


def _derive(nodes) -> tuple[set[str] | None, Query]:
    """What a sequence can match, if that is a small set of strings, and a query besides."""
    run: set[str] = {""}  # strings that end where we stand
    query: Query = None
    whole = True
    for op, arg in nodes:
        part, q = _node(op, arg)
        query = _both(query, q)
        if part is not None and len(joined := {x + y for x, y in product(run, part)}) <= MOST:
            run = joined
        else:
            query, whole = _both(query, _grams(run)), False
            if part is not None:
                query = _both(query, _grams(part))
            run = {""}
    return (run, query) if whole else (None, _both(query, _grams(run)))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is c.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, None
    if op is c.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is c.LITERAL:
                chars.add(chr(x).lower())
            elif kind is c.RANGE and x[1] - x[0] < MOST and x[1] < 128:
                chars |= {chr(y).lower() for y in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is c.SUBPATTERN:
        return _derive(arg[3])
    if op is c.BRANCH:
        exact: set[str] | None = set()
        alternatives: frozenset | None = frozenset()
        for branch in arg[1]:
            e, q = _derive(branch)
            full = _both(q, _grams(e)) if e is not None else q
            exact = None if exact is None or e is None else exact | e
            alternatives = None if alternatives is None or full is None else alternatives | full
        return exact, None if alternatives is None else _least(alternatives)
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, inner = arg
        e, q = _derive(inner)
        if least == 0:
            return ({""} | e, None) if most == 1 and e is not None else (None, None)
        return (e, q) if most == 1 else (None, _both(q, _grams(e)) if e is not None else q)
    return None, None


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for alt in trigram_query(r.pattern) or () for t in alt})


def _key(docs: DataFrame) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit("")))))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_key) of the trigrams that the rules' queries use."""
    terms = F.array(*map(F.lit, vocabulary(rules)))
    found = let(F.lower(F.coalesce(docs["text"], F.lit(""))), lambda t: F.filter(terms, lambda x: F.contains(t, x)))
    return docs.select(_key(docs).alias("doc_key"), F.explode(found).alias("trigram")).select("trigram", "doc_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_key, rules): documents whose postings satisfy some rule's query, with one bit a rule."""
    words, bit = vocabulary(rules), {}
    sets = []
    for start in range(0, len(words), 60):
        block = words[start : start + 60]
        bit |= {t: (start // 60, i) for i, t in enumerate(block)}
        value = F.element_at(F.create_map(*[x for i, t in enumerate(block) for x in (F.lit(t), F.lit(1 << i).cast("long"))]), F.col("trigram"))
        sets.append(F.bit_or(F.coalesce(value, F.lit(0).cast("long"))).alias(f"s{start // 60}"))
    if not sets:
        return index.select("doc_key", F.lit(0).cast("long").alias("rules")).where("false")

    def satisfied(q: frozenset) -> Column:
        out = F.lit(False)
        for alt in q:
            all_ = F.lit(True)
            for s in range(len(sets)):
                need = sum(1 << bit[t][1] for t in alt if bit[t][0] == s)
                if need:
                    all_ = all_ & (F.col(f"s{s}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
            out = out | all_
        return out

    total = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        if q := trigram_query(r.pattern):
            total = total.bitwiseOR(F.when(satisfied(q), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return index.groupBy("doc_key").agg(*sets).select("doc_key", total.alias("rules")).where("rules != 0")


def _pieces(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in a text and what is before each, as an array of lengths: before (a), match (b), limited group (c)."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("a"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("b"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("c"),
    )
    found = F.transform(parts, lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("i"), x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c")))
    return F.when(F.regexp_like(text, pattern), F.filter(found, lambda x: x["b"].isNotNull())).otherwise(F.expr("cast(array() as array<struct<order:int,i:int,a:int,b:int,c:int>>)"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """(doc_key, found) of the documents with matches: their spans (start, order of kind, end), sorted."""
    bits = cut(candidates(build_index(docs, rules) if index is None else index, rules))
    texts = docs.where("text is not null").select(_key(docs).alias("doc_key"), docs["text"].alias("text"))
    free = [_pieces(F.col("text"), r, i) for i, r in enumerate(rules) if trigram_query(r.pattern) is None]
    bound = [F.when(F.col("rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0, _pieces(F.col("text"), r, i)).otherwise(F.expr("cast(array() as array<struct<order:int,i:int,a:int,b:int,c:int>>)")) for i, r in enumerate(rules) if trigram_query(r.pattern) is not None]
    parts = [texts.select("doc_key", F.explode(F.concat(*free)).alias("x"))] if free else []
    parts += [texts.join(small(bits, BROADCAST_CANDIDATES), "doc_key").select("doc_key", F.explode(F.concat(*bound)).alias("x"))] if bound else []
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    rows = rows.select("doc_key", "x.*").dropDuplicates(["doc_key", "order", "i"])  # rows that repeat id and text
    end = F.sum(F.col("a") + F.col("b")).over(Window.partitionBy("doc_key", "order").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("order") + 1)
    rows = rows.withColumn("end", end).where(F.col("c") >= least)
    return rows.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("b")).alias("start"), "order", "end"))).alias("found"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """Every row of `docs` with `found`: its spans (start, order of kind, end), sorted."""
    keep = [x for x in docs.columns if x != "found"]
    name = next(f"_key{i}" for i in range(len(keep) + 1) if f"_key{i}" not in keep)
    found = find(docs, rules, index).withColumnRenamed("doc_key", name)
    # Columns stay apart, so that a caller who doesn't ask for the text doesn't have it shuffled.
    rows = docs.select(*keep, _key(docs).alias(name)).join(found, name, "left")
    return rows.select(*keep, F.coalesce("found", F.expr("cast(array() as array<struct<start:int,order:int,end:int>>)")).alias("found"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of `docs` with counts of the base kinds, the digest of their spans, and all spans as text."""
    out = scan(docs.drop(*[c for c in ADDED if c in docs.columns]), rules)
    base = F.filter("found", lambda s: s["order"].isin([i for i, r in enumerate(rules) if r.base]))
    of_kind = lambda i: F.size(F.filter("found", lambda s: s["order"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    return out.select("*", *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("found"), rules).alias("spans")).drop("found")
