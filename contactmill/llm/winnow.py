"""Benchmark decontamination by winnowing, exact after extension.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. Every K-gram of words is
hashed and the minimum of each WINDOW consecutive hashes is kept as a fingerprint, on both sides, so any shared span of
SPAN = K + WINDOW - 1 words leaves a common fingerprint. Items of fewer words than SPAN have one fingerprint, the hash of
all their words, and are one window.

A fingerprint is joined together with what extends it: the window of SPAN words that it stands for. So texts that share a fingerprint
and nothing longer (a common lead sentence) never meet, however many they are, and a join's rows are occurrences of windows. Equal
windows of many items are one row of the join; the lists of items that hold a window are named by a digest, of which a document
has each once, and are added when its windows are together. Before a document's windows leave a Python worker, their fingerprints
and hashes pass two filters of FILTER_BITS bits of the items', whose size doesn't depend on the benchmark's. Hashes only
propose, words decide: the join compares the windows' words. Windows of a document that overlap or touch make spans.

Null text has no words; a document without words is clean. An item without words, or without an id, is skipped. Items
with one id count as one. Documents may repeat, and have null ids; those with equal id and text share their result. Other
columns pass through; an input column with the name of an added one is replaced. An empty benchmark leaves every document
clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gathered, map_texts, small

SPAN, K = 13, 7
WINDOW = SPAN - K + 1
#: Bits of the filter, 1 MB.
FILTER_BITS = 1 << 23
#: Numbers in the spans and items of all documents together, up to which they are broadcast.
BROADCAST_NUMBERS = 100_000
CACHE_WORDS = 300_000
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")

_FOLD = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
#: One of the words above, upper case included, for Java. A class of two parts: with the same characters as three or more excluded
#: ranges, threads of one JVM take several times as long as one alone.
_WORD = r"[\p{Alnum}\x{80}-\x{10FFFF}]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Hashes(dict):
    """Word to 64-bit hash; forgets all words when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; runs of different length hash differently."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * _BASE
        out ^= out >> np.uint64(29)
    return out


def lows(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each WINDOW consecutive hashes: of each window of SPAN words its fingerprint."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.uint64)
    low = hashes[: len(hashes) - WINDOW + 1].copy()
    for j in range(1, WINDOW):
        np.minimum(low, hashes[j : j + len(low)], out=low)
    return low


def winnow(hashes: np.ndarray) -> np.ndarray:
    """The distinct minima of each WINDOW consecutive hashes."""
    return np.unique(lows(hashes))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _at(hashes: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """`grams(hashes, k)` at some places only."""
    out = np.full(len(places), k, np.uint64)
    for j in range(k):
        out = (out ^ hashes[places + j]) * _BASE
        out ^= out >> np.uint64(29)
    return out


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, size, print, full, words): the windows of the items, each with its fingerprint, the hash of all its words, and those
    words; size is SPAN or the words of a shorter item."""

    def start():
        hashes = Hashes()

        def step(texts):
            out = []
            for t in texts:
                ws = words(t)
                h = np.array([hashes[w] for w in ws], np.uint64)
                k = min(SPAN, len(h))
                full = grams(h, k) if k else h
                low = lows(grams(h, K)) if k == SPAN else full
                out.append([{"size": k, "print": int(p), "full": int(f), "words": b" ".join(ws[j : j + k]).decode()} for j, (p, f) in enumerate(zip(low.view(np.int64), full.view(np.int64)))])
            return [out]

        return step

    out = map_texts(items, ["item_id"], "windows array<struct<size:int,print:long,full:long,words:string>>", start)
    return out.select("item_id", F.explode("windows").alias("w")).select("item_id", "w.*").distinct()


def print_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """The places of all hashes, as bits: FILTER_BITS / 64 numbers, however many hashes there are."""
    place = F.shiftrightunsigned(F.col(column), 64 - (FILTER_BITS.bit_length() - 1))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({column}, {64 - (FILTER_BITS.bit_length() - 1)}), 64) as int))")
    rows = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def document_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, place, size, print, words): the windows of rows (key, text) that pass both filters."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    held = rows.sparkSession.sparkContext.broadcast((print_filter(windows, "print"), print_filter(windows, "full"), sizes))

    def start():
        hashes, (prints, fulls, sizes) = Hashes(), held.value
        shift = np.uint64(64 - (len(prints).bit_length() - 1))

        def step(texts):
            out = []
            for t in texts:
                ws, got = words(t), []
                h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
                for k in sizes:
                    low = lows(grams(h, K)) if k == SPAN else grams(h, k)
                    at = np.flatnonzero(prints[(low >> shift).astype(np.int64)])
                    at = at[fulls[(_at(h, at, k) >> shift).astype(np.int64)]]
                    got += [{"place": j, "size": k, "print": p, "words": b" ".join(ws[j : j + k]).decode()} for j, p in zip(at.tolist(), low.view(np.int64)[at].tolist())]
                out.append(got)
            return [out]

        return step

    out = map_texts(rows, ["key"], "windows array<struct<place:int,size:int,print:long,words:string>>", start)
    return out.select("key", F.explode("windows").alias("w")).select("key", "w.*")


def found_spans(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, spans, items) of rows (key, text) in which windows of items occur."""
    kind = "array<struct<s:int,e:int>>"
    held = windows.groupBy("size", "print", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    held = held.withColumn("list", F.md5(F.array_join(F.transform("items", lambda x: x.cast("string")), ",")))
    lists = held.groupBy("list").agg(F.first("items").alias("items"))

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(spans=[[{"s": a, "e": b} for a, b in merged([(x["s"], x["e"]) for x in s])] for s in p["spans"]])

    hits = document_windows(rows, windows).join(small(held.drop("items")), ["size", "print", "words"])
    of = hits.groupBy("key").agg(F.collect_set(F.struct(F.col("place").alias("s"), (F.col("place") + F.col("size")).alias("e"))).alias("spans"), F.collect_set("list").alias("lists"))
    of = of.mapInPandas(merge, f"key string, spans {kind}, lists array<string>")
    named = of.select("key", F.explode("lists").alias("list")).join(small(lists), "list").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return of.drop("lists").join(named, "key")


def _digest(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of `docs` with n_words, n_hit, n_items, items_sha256 and contaminated; `spans` and `items` are added too."""
    keep = [c for c in docs.columns if c not in (*ADDED, "spans", "items")]
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    scratch = Scratch(docs.sparkSession, "winnow")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    windows = scratch.put("windows", gathered(item_windows(items), items.count()))
    # Rows that repeat give the same windows, of which a document has each once.
    found = scratch.put("found", gathered(found_spans(docs.where("text is not null").select(key.alias("key"), "text"), windows), docs.count()))
    scratch.drop("windows")
    numbers = found.agg(F.sum(F.size("spans") + F.size("items"))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        found = F.broadcast(found)
    # Counted behind the join, so that a caller who only asks for contaminated documents has the words of few texts counted.
    n_words = F.coalesce(F.regexp_count("row.text", F.lit(_WORD)), F.lit(0)).cast("long")
    out = docs.select(F.struct(*keep).alias("row"), key.alias("key")).join(found, "key", "left").withColumn("n_words", n_words)
    out = out.withColumns({"spans": F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,e:int>>)")), "items": F.coalesce("items", F.expr("cast(array() as array<bigint>)"))})
    hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x["e"] - x["s"]).cast("long")
    out = out.select("row.*", "n_words", "spans", "items", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), _digest(F.col("items")).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest_of(items: list[int]) -> str:
    """The same digest in Python, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
