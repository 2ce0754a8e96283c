"""Quality rules as a ledger of failure bits; DataFrame functions only.

Every rule is evaluated once, on the whole text, whatever its policy: the ledger keeps the measurements and one bit a
rule. A policy is a named, versioned set of rules; applying one, or asking what a policy would keep without one of its
rules, reads bits and never the text again. Ablations first count rows by bit pattern, of which there are at most
2^rules, and go on from those counts.

Words are runs of characters other than the six of ASCII white space. The 3-word windows of a text are compared within
its row by sorting them, so nothing is shuffled. Null and empty texts have no words: they measure 0 everywhere and fail
the rule on few words. Null ids, repeated rows and empty input are allowed. Other columns pass through; an input column
with the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Name and failure condition of each rule, in the order of their bits. All compare whole numbers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = {(p.name, p.version): p for p in (BASE, Policy("web", 1, (*BASE.rules, "symbols")), Policy("web", 2, tuple(n for n, _ in RULES)))}
DEFAULT = POLICIES["web", 2]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body, or a lambda in it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that are in a 3-word window which the text holds twice or more."""

    def count(w: Column) -> Column:
        n = F.size(w)
        windows = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), n).alias("b"), F.slice(w, F.lit(3), n).alias("c"), F.sequence(F.lit(0), n - 1).alias("i")), F.lit(1), n - 2)
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        twice = lambda s: F.filter(s, lambda x, k: (F.when(k > 0, same(F.get(s, k - 1), x)).otherwise(False)) | (F.when(k < F.size(s) - 1, same(F.get(s, k + 1), x)).otherwise(False)))
        at = F.transform(let(F.sort_array(windows), twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.when(n < 3, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(at))))

    return let(words, count)


def measure(docs: DataFrame) -> DataFrame:
    """Every row of `docs` with the measurements, all long."""
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    keep = [c for c in docs.columns if c not in (*MEASURES, "failed")]
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    found = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeat_words(F.col("words")),
        "n_lines": F.size("lines"),
    }
    return rows.select("row", *[found[m].cast("long").alias(m) for m in MEASURES]).select("row.*", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """Every row of `docs` with the measurements and `failed`, a long with bit i set if rule i fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failed", total)


def fails(policy: Policy) -> Column:
    """Whether a ledger row fails any rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Ledger rows with base_failed and kept (no base failure, and no failure of the policy's rules)."""
    return rows.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(policy)})


def ablations(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One row a rule of the policy: rows that fail it, rows that fail it alone, and rows kept without it."""
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    names = [n for n, _ in RULES]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    c = counts.select("failed", "n", each.alias("x")).select("failed", "n", "x.rule", "x.bit")
    has, alone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed") == F.col("bit")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return c.groupBy("rule").agg(add(has).alias("n_failed"), add(alone).alias("n_alone"), add(alone | (F.col("failed") == 0)).alias("n_kept_without"))
