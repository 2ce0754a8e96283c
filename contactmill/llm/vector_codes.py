"""Vector code compression: product codebooks by k-means on whole numbers, nearest entries screened in float32.

Components become whole numbers, floor(256 * x), and a vector is cut into PARTS equal parts. For all vectors of a batch and all
entries of a part's codebook one float32 matrix product gives |c|^2 - 2 x.c, which orders entries as their distances do.
Its rounding error has a proven bound: a dot product of n terms in precision u, summed in any order, errs by at most
g(n) * |x||c| with g(n) = n u / (1 - n u), and the factors' own rounding and the last sum add a few u more. Every entry
whose interval overlaps that of the best is re-evaluated in int64, and the least index wins among equal distances. So the
codes are those of exact arithmetic. Components too large for exact sums in int64 are worked in Python's whole numbers.

A round is one pass: each task adds up its vectors by part and entry, and emits no more rows than there are entries; Spark
adds those up. What the driver holds is the codebooks, ENTRIES vectors.

A vector that is null, or holds a null or non-finite component, is dropped; so is one that can't be cut into equal parts (its length
is no positive multiple of PARTS) or compared (its length isn't that of the kept row of least id). Rows start the codebooks by
ascending id, then vector, nulls last; with fewer than ENTRIES rows all of them do. Null ids, null labels (which count as equal),
repeated rows and empty input are allowed. Sums above 2^63 - 1 are given as that. Other columns pass through; an input
column with the name of an added one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ADDED = ("code", "error", "label_error", "codebooks_sha256")
#: Magnitude of components below which squared distances and their sums are exact in int64, for vectors of up to 4096.
EXACT = 1 << 24
MOST = (1 << 63) - 1
#: Vectors that are worked at once.
BATCH = 4096

Codebooks = list[list[list[int]]]  # by part, entry, place


def usable(vector: Column) -> Column:
    """Whether a vector can be coded; null vectors can't."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & F.forall(vector, finite), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64, or Python's whole numbers where some are large."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < EXACT:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


def first_codebooks(rows: list[np.ndarray]) -> Codebooks:
    width = len(rows[0]) // PARTS
    return [[[int(v) for v in row[p * width : (p + 1) * width]] for row in rows] for p in range(PARTS)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest entry, the lower one in a tie, and the squared distance; both exact."""
    n, d = x.shape
    if x.dtype == object or entries.dtype == object:
        far = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        best = np.array([min(range(len(entries)), key=r.__getitem__) for r in far], np.int64)
        return best, far[np.arange(n), best]
    xf, cf = x.astype(np.float32), entries.astype(np.float32)  # exact: below 2^24
    c2 = (entries.astype(np.float64) ** 2).sum(1)  # exact: below 2^53
    screen = xf @ (-2 * cf).T + c2.astype(np.float32)
    u = 2.0**-24
    gamma = (d + 4) * u / (1 - (d + 4) * u)
    # 2 |x||c| bounds the product's terms, |c|^2 the square; norms are themselves rounded, hence the last factor.
    bound = gamma * (2 * np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(c2) + c2) * (1 + 2.0**-40)
    low, high = screen - bound, (screen + bound).min(1)
    row, entry = np.nonzero(low <= high[:, None] + 2.0**-40 * np.abs(high[:, None]))
    exact = ((x[row] - entries[entry]) ** 2).sum(1)
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(exact, begins)
    hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[begins, len(row)])))
    first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # entries ascend within a row
    return entry[first], least


def _batches(column: pd.Series, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, len(column), BATCH):
        part = column.iloc[at : at + BATCH]
        yield slice(at, at + BATCH), whole(np.stack(part.to_list())).reshape(len(part), PARTS, width)


def _arrays(books: Codebooks) -> list[np.ndarray]:
    large = any(abs(v) >= EXACT for p in books for e in p for v in e)
    return [np.array(p, object if large else np.int64).reshape(len(p), -1) for p in books]


def step(rows: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry the floor of its parts' mean, unused entries as they were."""
    width = len(books[0][0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = _arrays(books)
        sums, counts = [[[0] * width for _ in p] for p in books], [[0] * len(p) for p in books]
        for frame in frames:
            for _, x in _batches(frame[vector], width):
                for p in range(PARTS):
                    best, _ = nearest(x[:, p], entries[p])
                    order = np.argsort(best, kind="stable")
                    used, begins = np.unique(best[order], return_index=True)
                    for k, total, n in zip(used, np.add.reduceat(x[order, p], begins), np.diff(np.r_[begins, len(best)]), strict=True):
                        counts[p][k] += int(n)
                        sums[p][k] = [a + int(b) for a, b in zip(sums[p][k], total, strict=True)]
        out = [(p, k, counts[p][k], [str(v) for v in sums[p][k]]) for p in range(PARTS) for k in range(len(books[p])) if counts[p][k]]
        yield pd.DataFrame(out, columns=["part", "entry", "n", "sums"])

    found = rows.select(vector).mapInPandas(run, "part int, entry int, n long, sums array<string>")
    # Exact sums of up to 38 digits; one row a place of an entry reaches the driver.
    found = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "v"))
    found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [[list(e) for e in p] for p in books]
    for r in found.collect():
        out[r["part"]][r["entry"]][r["place"]] = int(r["v"]) // r["n"]
    return out


def coded(rows: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """Rows with `code`, two hex digits a part, and `error`, the squared distances summed over parts."""
    width = len(books[0][0])
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = _arrays(books)
        for frame in frames:
            for where, x in _batches(frame[vector], width):
                found = [nearest(x[:, p], entries[p]) for p in range(PARTS)]
                codes = np.stack([k for k, _ in found], 1).astype(np.uint8)
                errors = sum(e.astype(object) for _, e in found)
                part = frame.iloc[where].copy()
                part["code"] = [c.tobytes().hex() for c in codes]
                part["error"] = [min(int(e), MOST) for e in errors]
                yield part[[*names, "code", "error"]]

    return rows.mapInPandas(run, schema)


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()


def train(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of usable rows of one length, which start from the rows of least key; None without rows."""
    start = rows.select(key, vector).orderBy(F.asc_nulls_last(key), vector).limit(ENTRIES).collect()
    if not start:
        return None
    books = first_codebooks([whole(np.array([r[vector]], np.float64))[0] for r in start])
    for _ in range(rounds):
        books = step(rows, vector, books)
    return books


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """Every usable row, of its columns `keep` or all, with code, error, the error of its label's rows, and the codebooks' digest."""
    keep = [c for c in keep or vectors.columns if c not in ADDED]
    rows = vectors.where(usable(F.col(vector))).select(F.struct(*keep).alias("_row"), F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector"))
    one = rows.select("_key", "_vector").orderBy(F.asc_nulls_last("_key"), "_vector").limit(1).collect()
    if one:
        rows = rows.where(F.size("_vector") == len(one[0]["_vector"]))
    books = train(rows, "_vector", "_key")
    if books is None:
        kinds = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return rows.limit(0).select("_row.*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    found = cut(coded(rows, "_vector", books).drop("_vector", "_key"))
    total = found.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    total = small(total.withColumnRenamed("_label", "_of"))
    out = found.join(total, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select("_row.*", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
