"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as half of
(sum_i v_i x_i)^2 - sum_i (v_i x_i)^2, over factors. Features of a text: its words (ASCII letters lower-cased), hashed to
BUCKETS, with weights 1 + ln(count) scaled to norm 1; structure statistics, each one-hot in BINS quantile bins; and
n_chars, where the table has it, binned likewise as metadata. Labels, language, source and id are never features.

The model is fitted in numpy on a bounded sample: at most TRAIN_ROWS labelled rows (also where ids repeat), those with the
lowest hash of their id, taken from the whole table, held-out ids aside. A row with several labels counts as their mean, rounded. Features of the sample are made on
the executors. Everything else reads every row whole.

Null and empty texts get a score from their structure features alone. Null labels are left out; without labels every
score is 0.5. With one class only, the score is that class's prior. Repeated rows score alike. Other columns pass
through; an input column with the name of an added one is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts

TRAIN_ROWS = 4000
BUCKETS, FACTORS, BINS = 1 << 14, 4, 12
EPOCHS, BATCH, RATE, DECAY = 24, 128, 0.08, 1e-4
#: Tasks that make the sample's features.
SAMPLE_PARTS = 12
ADDED = ("held_out", "score", "predicted")
CACHE_WORDS = 300_000
STATS = ("words", "word_length", "symbols", "digits", "upper", "punctuation", "line_words", "repeat_lines", "distinct", "repeat_pairs", "n_chars")

_SYMBOL = re.compile(rb"[#*$%&|<>]")
_DIGIT = re.compile(rb"[0-9]")
_UPPER = re.compile(rb"[A-Z]")
_STOP = re.compile(rb"[.,;:!?]")


class Buckets(dict):
    """Word to bucket, by hash; forgets all words when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word) % BUCKETS
        return got


def statistics(text: bytes, ws: list[bytes], codes: np.ndarray, n_chars: int | None) -> list[float]:
    n, size = max(1, len(ws)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = codes[:-1] * BUCKETS + codes[1:]
    count = lambda p: len(p.findall(text)) / size
    return [
        np.log1p(len(ws)), size / n, count(_SYMBOL), count(_DIGIT), count(_UPPER), len(_STOP.findall(text)) / n, len(ws) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), len(np.unique(codes)) / n, 1 - len(np.unique(pairs)) / max(1, len(pairs)), -1.0 if n_chars is None else np.log1p(max(0, n_chars)),
    ]


class Featurizer:
    """Texts to sparse rows: (row starts, feature numbers, values) of the words, and the statistics."""

    def __init__(self) -> None:
        self.buckets = Buckets()

    def __call__(self, texts: list[bytes | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        find, starts, idx, val, stats = self.buckets.__getitem__, [0], [], [], []
        for text, chars in zip(texts, n_chars, strict=True):
            text = text or b""
            ws = text.lower().split()
            codes = np.fromiter(map(find, ws), np.int64, len(ws))
            number, count = np.unique(codes, return_counts=True)
            weight = 1 + np.log(count)
            idx.append(number)
            val.append(weight / np.sqrt((weight**2).sum()) if len(weight) else weight)
            starts.append(starts[-1] + len(number))
            stats.append(statistics(text, ws, codes, chars))
        return np.array(starts), np.concatenate(idx), np.concatenate(val), np.array(stats)


class Machine:
    """A fitted model; small: (BUCKETS + statistics * BINS) * (FACTORS + 1) numbers."""

    def __init__(self, edges: np.ndarray, prior: float = 0.0, seed: int = 7) -> None:
        self.edges, self.w0 = edges, prior
        size = BUCKETS + len(STATS) * BINS
        self.w, self.v = np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (size, FACTORS))

    def rows(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add the binned statistics to every row, so that no row is empty."""
        binned = np.stack([np.searchsorted(e, stats[:, j], "right") + BUCKETS + j * BINS for j, e in enumerate(self.edges)], axis=1)
        at = np.repeat(starts[:-1], len(STATS))
        return starts + np.arange(len(starts)) * len(STATS), np.insert(idx, at, binned.ravel()), np.insert(val, at, 1 / np.sqrt(len(STATS)))

    def logits(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xv = self.v[idx] * val[:, None]
        total = np.add.reduceat(xv, starts[:-1])
        pairs = 0.5 * (total**2 - np.add.reduceat(xv**2, starts[:-1])).sum(axis=1)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts[:-1]) + pairs, total

    def fit(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray) -> None:
        """Minibatch AdaGrad on the logistic loss; the same result for the same rows."""
        rng, size = np.random.default_rng(1), len(self.w)
        gw, gv, g0 = np.full(size, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                take = order[at : at + BATCH]
                n = starts[take + 1] - starts[take]
                s = np.concatenate(([0], np.cumsum(n)))
                pick = np.repeat(starts[take] - s[:-1], n) + np.arange(s[-1])
                i, x = idx[pick], val[pick]
                z, total = self.logits(s, i, x)
                d = (1 / (1 + np.exp(-z)) - y[take]) / len(take)
                each = np.repeat(d, n) * x
                w = np.bincount(i, each, size) + DECAY * self.w * (used := np.bincount(i, minlength=size) > 0)
                gw += w**2
                self.w -= RATE * w / np.sqrt(gw)
                of = np.repeat(total, n, axis=0)
                for f in range(FACTORS):
                    v = np.bincount(i, each * (of[:, f] - self.v[i, f] * x), size) + DECAY * self.v[:, f] * used
                    gv[:, f] += v**2
                    self.v[:, f] -= RATE * v / np.sqrt(gv[:, f])
                g0 += (g := d.sum()) ** 2
                self.w0 -= RATE * g / np.sqrt(g0)

    def score(self, features: tuple[np.ndarray, ...]) -> np.ndarray:
        z, _ = self.logits(*self.rows(*features))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> list:
    """Packed features and label of at most `rows` labelled documents, as collected rows."""
    use = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("_y"))
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so a broadcast of it is bounded
    found = docs.join(F.broadcast(use), "doc_id").select("doc_id", "text", "_y", (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars"))
    # Ids may repeat in the documents: the rows are bounded too, by a merge of each task's first ones.
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "n_chars").limit(rows)

    def start():
        make = Featurizer()

        def step(texts, chars):
            s, i, v, t = make(texts, chars)
            return [i[a:b].astype("<i4").tobytes() for a, b in zip(s, s[1:])], [v[a:b].astype("<f4").tobytes() for a, b in zip(s, s[1:])], t.tolist()

        return step

    return map_texts(found.repartition(SAMPLE_PARTS), ["doc_id", "_y"], "i binary, v binary, t array<double>", start, ["n_chars"]).orderBy("doc_id", "i", "v").collect()


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> Machine | None:
    """The model, fitted on a bounded sample; None without labels."""
    sample = training_sample(docs, labels, rows, label)
    if not sample:
        return None
    y = np.array([r["_y"] for r in sample], float)
    stats = np.array([r["t"] for r in sample])
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = Machine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T, prior)
    if 0 < y.sum() < len(y):
        starts = np.concatenate(([0], np.cumsum([len(r["i"]) // 4 for r in sample])))
        idx, val = (np.frombuffer(b"".join(r[c] for r in sample), kind) for c, kind in (("i", "<i4"), ("v", "<f4")))
        model.fit(*model.rows(starts, idx.astype(np.int64), val.astype(float), stats), y)
    else:
        model.v[:] = 0
    return model


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> DataFrame:
    """Every row of `docs` with held_out, score and predicted (1 where score >= 0.5)."""
    keep = [c for c in docs.columns if c not in ADDED]
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows, label))
    chars = "n_chars" in docs.columns

    def start():
        make, model = Featurizer(), held.value

        def step(texts, n_chars=None):
            if model is None:
                return [[0.5] * len(texts)]
            return [model.score(make(texts, n_chars or [None] * len(texts))).tolist()]

        return step

    out = map_texts(docs, keep, "score double", start, ["n_chars"] if chars else [])
    return out.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
