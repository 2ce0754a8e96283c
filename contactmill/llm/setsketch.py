"""MinHash near-dedup with SetSketch registers, exact after verification.

A document's set is its distinct word shingles. Documents with equal sets form a class, so copies cost one row each from
then on. A class gets REGISTERS registers: register i holds floor(1 - log_b x) of the least exponential variate x over
the set, truncated to 0..q + 1. Registers are mergeable by maximum and, with b near 1, equal in two sets with a
probability of about their Jaccard similarity J.

Bands are groups of ROWS registers; classes with an equal band share a bucket. At J = 0.8 two classes share no bucket with
probability below 1e-6. Components need few of a bucket's pairs, so pairs are made in steps, each of a few pairs a class:
every class with its buckets' first classes, then rings through the buckets that still hold several components, then every
class with the centre of its bucket's largest component (the class with the most links). Pairs are screened by set sizes
(exact) and by the likelihood estimate of J from the counts of greater, smaller and equal registers and both cardinalities,
jointly; of a class's pairs the likeliest is confirmed on the full sets. These steps need not find everything.

What links remain between components that share a bucket, `remaining_links` finds, all of them by an exact bound instead of
an estimate: a class is reduced to its differences from the centre, and only classes that share rare differences are
compared. A bucket of thousands of near copies, some of which fall just short of the similarity, is so never paired up.

Components are found by alternating large-star and small-star steps over the links, in the shared folder; only classes
with a link take part. Null texts and texts without words have an empty set and stand alone. Null ids take part; a
component's id is its least non-null id. Repeated rows are copies. Ties between pairs of one estimate, or between centres,
go to ids of classes and change no result. Empty input gives empty output. `near_duplicates`
returns ids and results only; `keep_one` passes every column through. Texts are shuffled only to confirm pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE_ROWS, WORD, Scratch, cut, gathered, map_texts, small

REGISTERS, ROWS, BANDS = 240, 6, 60
BASE, RATE, TOP = 1.001, 20.0, 65_534
SCREEN = 0.17
#: Rounds of rings, and classes in a ring.
RINGS, RING = 1, 1000
#: Keys of classes, 8 bytes each, that may be broadcast to find their texts.
BROADCAST_CLASSES = 500_000
CACHE_WORDS = 300_000

_MIX = np.random.default_rng(11).integers(0, 2**64, (2, REGISTERS), np.uint64)
_MIX[0] |= np.uint64(1)
_PICK = np.random.default_rng(12)
#: Registers of each band: random subsets, all registers used about alike.
_BANDS = np.concatenate([_PICK.permutation(REGISTERS) for _ in range(-(-BANDS * ROWS // REGISTERS))])[: BANDS * ROWS].reshape(BANDS, ROWS)


class Hashes(dict):
    """Word to 64-bit hash; forgets all words when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def shingle_set(text: bytes | None, k: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence where there are fewer words."""
    ws = text.lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = min(k, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(values: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of hashes."""
    low = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(low, (values[at : at + 512, None] * _MIX[0] + _MIX[1]).min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def joint_estimate(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Most likely J from the numbers of registers that are greater in the first and in the second set."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    equal = REGISTERS - more - less
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        a, b = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)
    for _ in range(40):  # the likelihood has one peak
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def sketched(docs: DataFrame, keep: list[str], k: int) -> DataFrame:
    """Rows with n_shingles, set_key (128 bits of the set; null if empty) and sketch."""

    def start():
        hashes, last = Hashes(), {}

        def step(texts):
            sizes, keys, sketches = [], [], []
            for t in texts:
                s = shingle_set(t, k, hashes)
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if key is not None and key not in last:
                    if len(last) >= 256:
                        last.clear()
                    last[key] = registers(s).tobytes()
                sizes.append(len(s))
                keys.append(key)
                sketches.append(last.get(key))
            return sizes, keys, sketches

        return step

    return map_texts(docs, keep, "n_shingles long, set_key binary, sketch binary", start)


def _row_key(docs: DataFrame) -> Column:
    """A hash of id and text. Not unique for certain; what is joined by it is checked again."""
    return F.xxhash64("doc_id", docs["text"]).alias("row_key")


def band_keys(classes: DataFrame) -> DataFrame:
    """(band, cid, n): a 64-bit key of each band of each class."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            r = np.frombuffer(b"".join(p["sketch"]), "<u2").reshape(-1, REGISTERS).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(r), BANDS)).copy()
            for j in range(ROWS):
                h = (h ^ r[:, _BANDS[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            yield pd.DataFrame({"band": h.view(np.int64).ravel(), "cid": np.repeat(p["cid"].to_numpy(), BANDS), "n": np.repeat(p["n"].to_numpy(), BANDS)})

    return classes.select("cid", "n", "sketch").mapInPandas(run, "band long, cid long, n int")


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b).cast("long")


def screen(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """`pairs` (a, b, ra, rb) that the joint estimate j doesn't rule out, with j."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), "<u2").reshape(-1, REGISTERS) for c in ("sa", "sb"))
                j = joint_estimate((x > y).sum(axis=1), (x < y).sum(axis=1), p["na"].to_numpy(float), p["nb"].to_numpy(float))
                yield p[["a", "b", "ra", "rb"]].assign(j=j)[j >= percent / 100 - SCREEN]

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(F.col("na"), F.col("nb"), percent))
    return near.select("a", "b", "ra", "rb", "sa", "sb", "na", "nb").mapInPandas(run, "a long, b long, ra long, rb long, j double")


def full_sets(docs: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """`used` classes (cid, n, set_key, row_key, sketch) with `items`, the hashes of their shingles."""

    def start():
        hashes = Hashes()

        def step(texts):
            sets = [shingle_set(t, k, hashes) for t in texts]
            return [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets]

        return step

    found = docs.select(_row_key(docs), "text").join(small(used.select("row_key").distinct(), BROADCAST_CLASSES), "row_key", "left_semi")
    found = map_texts(found, [], "set_key binary, items array<long>", start)  # row_key may collide, set_key decides
    return used.join(found.groupBy("set_key").agg(F.first("items").alias("items")), "set_key").select("cid", "n", "sketch", "items")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ra, rb) whose full sets reach the similarity."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("items").alias(f"i{x}"))
    both = F.size(F.array_intersect("ia", "ib"))
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    return found.where(100 * both >= percent * (F.size("ia") + F.size("ib") - both)).select("a", "b", "ra", "rb")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for every end of a link (u, v): root is the least of its component. Large-star and small-star in turn.

    Least neighbours are found by an aggregation, of which each task sends a row a class at most, and given to the edges by a
    join, whose tasks Spark parts where one class (a hub, in the end each component's least) has most of the edges."""
    edges = scratch.put("edges", links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), links.count())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(edges)
    while before[0]:
        # Large star: each neighbour above u joins the least of u and its neighbours.
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.put("large", both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), before[0])
        # Small star: u and its neighbours below join the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.put("edges", below.union(low.select("u", F.col("m").alias("v"))).distinct(), before[0])
        after = mark(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct())


def centres(open_: DataFrame, roots: DataFrame, degrees: DataFrame) -> DataFrame:
    """(band, pivot, pn, pr): of each bucket's largest component, the class with the most links, its size and its root."""
    best = F.max(F.struct("d", (-F.col("cid")).alias("m"), "n")).alias("best")
    parts = roots.join(degrees, "cid", "left").withColumn("d", F.coalesce("d", F.lit(0).cast("long"))).groupBy("root").agg(F.count(F.lit(1)).alias("weight"), best)
    parts = parts.select("root", "weight", (-F.col("best.m")).alias("pivot"), F.col("best.n").alias("pn"))
    top = open_.select("band", "root").distinct().join(parts, "root").groupBy("band").agg(F.max(F.struct("weight", "root", "pivot", "pn")).alias("top"))
    return top.select("band", F.col("top.pivot").alias("pivot"), F.col("top.pn").alias("pn"), F.col("top.root").alias("pr"))


def remaining_links(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(u, v): roots of different components that a link joins, among classes with one pivot; enough of them for all components.

    `members` (pivot, cid, n, root), about `rows`, includes the pivots. With D(x) the symmetric difference of x and its pivot, classes x
    and y differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, and they link iff that is at most (|x| + |y|) (100 - percent)
    / (100 + percent). With f(x) the share of that excess which x brings, the sum of both f is at most 2 |D(x) & D(y)|
    (all times 100 + percent). So x and y link if both f add up to 0 or less, and then both link with the class of least f;
    otherwise they must share so many differences, by which few can: differences are short, mostly each class's own, and
    the others are joined by the rarest ones only (prefix filter), under the bound that f and the number of shared differences set.
    """
    p, q = 100 + percent, 100 - percent
    rows = members.count() if rows is None else rows
    put = lambda name, df: scratch.put(name, gathered(df, rows))
    items = lambda c, name: sets.select(F.col("cid").alias(c), F.col("items").alias(name))
    delta = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    d = members.join(items("cid", "x"), "cid").join(items("pivot", "y"), "pivot").select("pivot", "cid", "n", "root", delta.alias("delta"))
    d = put("delta", d.withColumn("f", (p * F.size("delta") - q * F.col("n")).cast("long")))
    # Differences that several classes of a pivot have, rarest first.
    each = d.select("pivot", "cid", F.explode("delta").alias("t"))
    common = each.groupBy("pivot", "t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = each.join(common, ["pivot", "t"]).groupBy("pivot", "cid").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ts"))
    e = d.select("pivot", "cid", "root", "f").join(shared, ["pivot", "cid"], "left")
    e = put("shared", e.withColumn("r", F.col("f") - 2 * p * F.coalesce(F.size("ts"), F.lit(0))))
    # For each pivot the least f and r, and the least ones among the other roots.
    low = put("low", e.groupBy("pivot", "root").agg(F.min("f").alias("f"), F.min("r").alias("r")))
    first = low.groupBy("pivot").agg(F.min(F.struct("f", "root")).alias("f1"), F.min(F.struct("r", "root")).alias("r1"))
    other = lambda c: F.min(F.when(F.col("root") != F.col(f"{c}1.root"), F.col(c)))
    second = low.join(first, "pivot").groupBy("pivot").agg(F.first("f1").alias("f1"), F.first("r1").alias("r1"), other("f").alias("f2"), other("r").alias("r2"))
    second = put("bounds", second.where("f2 is not null"))
    e = e.join(second, "pivot")
    besides = lambda c: F.when(F.col("root") == F.col(f"{c}1.root"), F.col(f"{c}2")).otherwise(F.col(f"{c}1.{c}"))
    near = e.where((F.col("root") != F.col("f1.root")) & (F.col("f") + F.col("f1.f") <= 0)).select(F.col("root").alias("u"), F.col("f1.root").alias("v"))
    least = F.greatest(F.lit(1), F.ceil((F.col("f") + besides("f")) / (2 * p))).cast("int")
    some = e.where((F.size("ts") >= least) & (F.col("f") + besides("r") <= 0) & (F.col("r") + besides("f") <= 0))
    some = some.select("pivot", "cid", "root", "f", "r", F.explode(F.slice("ts", F.lit(1), F.size("ts") - least + 1)).alias("t")).select("pivot", "cid", "root", "f", "r", "t.t")
    # Differences that one root's members share pair nothing: roots are joined first, then those of their members that can link.
    some = put("some", some)
    per = some.groupBy("pivot", "t", "root").agg(F.min("f").alias("f"), F.min("r").alias("r"))
    x, y = (per.select("pivot", "t", *[F.col(c).alias(f"{c}_{i}") for c in ("root", "f", "r")]) for i in "ab")
    bound = (F.col("f_a") + F.col("r_b") <= 0) & (F.col("f_b") + F.col("r_a") <= 0)
    roots = x.join(y, ["pivot", "t"]).where((F.col("root_a") > F.col("root_b")) & bound).select("pivot", "t", "root_a", "root_b")
    x, y = (some.select("pivot", "t", *[F.col(c).alias(f"{c}_{i}") for c in ("cid", "root", "f", "r")]) for i in "ab")
    members = roots.join(x, ["pivot", "t", "root_a"]).join(y, ["pivot", "t", "root_b"]).where(bound)
    pairs = put("pairs", members.select("pivot", "cid_a", "cid_b", "root_a", "root_b").distinct())
    side = lambda i: d.select("pivot", F.col("cid").alias(f"cid_{i}"), F.col("f").alias(f"f_{i}"), F.col("delta").alias(f"d_{i}"))
    pairs = pairs.join(side("a"), ["pivot", "cid_a"]).join(side("b"), ["pivot", "cid_b"])
    found = pairs.where(F.col("f_a") + F.col("f_b") <= 2 * p * F.size(F.array_intersect("d_a", "d_b")))
    return put("last", near.union(found.select("root_a", "root_b")).distinct())


def _linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, n_shingles, set_key) and classes (set_key, root, component_id)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.put("rows", sketched(docs.select("doc_id", "text", _row_key(docs)), ["doc_id", "row_key"], k))
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min("row_key").alias("row_key"), F.max("n_shingles").cast("int").alias("n"), F.first("sketch").alias("sketch"))
    total = rows.count()
    # Gathered before they get their numbers: those are given by the task that stores them.
    classes = scratch.put("classes", gathered(classes, total).withColumn("cid", F.monotonically_increasing_id()))
    bands = band_keys(classes)
    buckets = bands.groupBy("band").agg(F.min("cid").alias("lo"), F.count(F.lit(1)).alias("size")).where("size > 1")
    open_ = bands.join(buckets, "band").select("band", "cid", "n", "size", "lo", F.col("cid").alias("root"))
    open_ = scratch.put("open", gathered(open_, BANDS * total, FILE_ROWS))
    held = open_.count()
    used = classes.join(open_.select("cid").distinct(), "cid", "left_semi")
    used = scratch.put("used", gathered(used.select("cid", "n", "set_key", "row_key", "sketch"), total))
    sets = scratch.put("sets", gathered(full_sets(docs, used, k), total))
    count = sets.count()
    roots = scratch.put("roots", sets.select("cid", "n", F.col("cid").alias("root")), count)
    degrees = None
    for step in range(RINGS + 3):
        if step:
            # Buckets that still hold several components.
            now = open_.drop("root").join(roots.select("cid", "root"), "cid")
            several = now.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("band")
            open_ = scratch.put("open", gathered(now.join(several, "band"), held, FILE_ROWS))
        if open_.isEmpty():
            break
        if step == 0:
            pairs = open_.select(F.col("cid").alias("a"), F.col("lo").alias("b"), F.col("root").alias("ra"), F.col("lo").alias("rb"))
        elif step <= RINGS:
            # A ring through each bucket, in parts of about RING classes, in a new order each time.
            ring = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(-step), "cid"), F.ceil(F.col("size") / RING))).withColumn("o", F.xxhash64(F.lit(step), "cid"))
            w, all_ = Window.partitionBy("band", "part").orderBy("o", "cid"), Window.partitionBy("band", "part").orderBy("o", "cid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            me = F.struct("cid", "root")
            pairs = ring.select("cid", "root", F.coalesce(F.lead(me).over(w), F.first(me).over(all_)).alias("x")).select(F.col("cid").alias("a"), F.col("x.cid").alias("b"), F.col("root").alias("ra"), F.col("x.root").alias("rb"))
        else:
            tops = scratch.put("tops", gathered(centres(open_, roots, degrees), held, FILE_ROWS))
            pairs = open_.join(tops, "band").select(F.col("cid").alias("a"), F.col("pivot").alias("b"), F.col("root").alias("ra"), F.col("pr").alias("rb"))
        if step < RINGS + 2:
            pairs = screen(pairs.where("ra != rb").distinct(), sets, percent)
            # Of a class's pairs the likeliest.
            pairs = pairs.groupBy("a", "ra").agg(F.max_by(F.struct("b", "rb"), F.struct("j", "b")).alias("x")).select("a", "ra", "x.b", "x.rb")
            found = scratch.put("found", gathered(confirm(pairs, sets, percent), count))
            ends = found.select(F.col("a").alias("cid"), F.lit(1).cast("long").alias("d")).union(found.select("b", F.lit(1).cast("long")))
            degrees = scratch.put("degrees", (ends if step == 0 else ends.union(degrees)).groupBy("cid").agg(F.sum("d").alias("d")), count)
            links = found.select(F.col("ra").alias("u"), F.col("rb").alias("v"))
        else:
            members = open_.join(tops, "band").select("pivot", "cid", "n", "root")
            members = members.union(tops.select("pivot", F.col("pivot").alias("cid"), F.col("pn").alias("n"), F.col("pr").alias("root"))).distinct()
            links = remaining_links(members, sets, percent, scratch, held)
        if links.isEmpty():
            continue
        new = components(links, scratch).select(F.col("v").alias("root"), F.col("root").alias("new"))
        roots = scratch.put("roots", roots.join(new, "root", "left").select("cid", "n", F.coalesce("new", "root").alias("root")), count)
    named = classes.join(roots.select("cid", "root"), "cid", "left").select("set_key", "id", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = scratch.put("named", gathered(named.join(least, "root").select("set_key", "root", "component_id"), total))
    scratch.drop(*(name for name in [*scratch.at] if name not in ("rows", "named")))
    return rows.drop("sketch"), named


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs`: doc_id, row_key, n_shingles, root (null if the set is empty), component_id, kept (it has that id)."""
    rows, classes = _linked(docs, k, percent)
    out = gathered(rows.join(classes, "set_key", "left"), rows.count())
    found = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", "n_shingles", "root", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, the one of least id, and every document with an empty set."""
    found = cut(near_duplicates(docs, k, percent))
    best = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("w"))
    best = best.select(F.col("w.doc_id").alias("_i"), F.col("w.row_key").alias("_k")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_d"), _row_key(docs), F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))).alias("_h"), F.regexp_like(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("_any"))
    kept = rows.where("_any").join(best, (F.col("row_key") == F.col("_k")) & F.col("_d").eqNullSafe(F.col("_i")), "left_semi")
    # Of rows that repeat id and text the one of least hash, so that reruns agree.
    kept = kept.groupBy("row_key", "_d").agg(F.min_by("row", "_h").alias("row"))
    return gathered(kept.select("row.*").unionByName(rows.where("not _any").select("row.*")), found.count())
