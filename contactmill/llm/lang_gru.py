"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes, trained in numpy.

A text is cut into segments of STEPS bytes. In both directions a gated recurrent unit of HIDDEN states reads a segment;
at every byte the two states give a probability for each language (so every position is labelled), and a text's
probabilities are the mean over its bytes that can be part of a letter. The prediction is the language with the highest
mean, the first by name in a tie, and its score that mean.

Trained by backpropagation through time, with Adam, on a bounded sample: of each language at most TRAIN_ROWS rows, those
with the lowest hash of their id, held-out ids aside, and of those as many as together have no more than the language's share of TRAIN_BYTES
bytes, one at least. Every language is learned that has a row of TRAIN_BYTES or less. An id that repeats
counts once, and rows without id aren't learned from. Their texts are learned from whole: batches go through all segments
in random order, again and again up to EPOCH_STEPS batches, and once at least. Prediction reads every text whole. Only text
is an input.

Null texts and texts without a letter get `und` and score 0, as do all texts if no row has a language. With one language
in the sample, that is every prediction. Null ids, repeated rows and empty input are allowed. Other columns pass through;
an input column with the name of an added one is replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_texts, small

TRAIN_ROWS, TRAIN_BYTES = 300, 48_000_000
#: Parts of a language from which its first rows are gathered.
SALT = 64
STEPS, HIDDEN = 96, 8
EPOCH_STEPS, BATCH, RATE = 260, 192, 0.02
WIDTH = 4096
ADDED = ("held_out", "lang_pred", "score")

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_PART = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace"))))


class Direction:
    """One gated recurrent unit; states are columns. Gates: z keeps the old state, r resets it."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        s = 1 / np.sqrt(hidden)
        self.E = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.U = rng.uniform(-s, s, (2 * hidden, hidden)).astype(np.float32)
        self.N = rng.uniform(-s, s, (hidden, hidden)).astype(np.float32)

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New state, gates and candidate after one byte in each column."""
        k = len(self.N)
        x = self.E.take(byte, axis=1)
        g = self.U @ h
        g += x[: 2 * k]
        g *= 0.5
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        n = self.N @ (g[k:] * h)
        n += x[2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= g[:k]
        new += n
        return new, g, n


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.both = [Direction(rng, hidden), Direction(rng, hidden)]
        self.O = rng.normal(0, 0.3, (2, len(langs), hidden)).astype(np.float32)
        self.b = np.zeros((len(langs), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*(w for d in self.both for w in (d.E, d.U, d.N)), self.O, self.b]

    def probabilities(self, x: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
        """Sums over the letter positions of each column of x (steps, columns): (languages, columns)."""
        steps, n = x.shape
        k = len(self.both[0].N)
        h, logits = np.zeros((k, n), np.float32), []
        for t in range(steps):
            h, _, _ = self.both[0].step(x[t], h)
            logits.append(self.O[0] @ h + self.b)
        h, out = np.zeros((k, n), np.float32), np.zeros((len(self.langs), n), np.float32)
        for t in reversed(range(steps)):
            h, _, _ = self.both[1].step(x[t], h)
            if valid is not None:
                h *= valid[t]
            p = self.O[1] @ h
            p += logits[t]
            np.exp(p, out=p)
            p *= _PART[x[t]] / p.sum(axis=0)
            out += p if valid is None else p * valid[t]
        return out

    def gradients(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over valid positions and its gradients, by backpropagation through time. y: one label a column."""
        steps, n = x.shape
        k = len(self.both[0].N)
        states = []
        for d, unit in enumerate(self.both):
            h, kept = np.zeros((k, n), np.float32), [None] * steps
            for t in range(steps) if d == 0 else reversed(range(steps)):
                new, g, c = unit.step(x[t], h)
                new *= valid[t]
                kept[t] = (h, g, c, new)
                h = new
            states.append(kept)
        count, loss = valid.sum(), 0.0
        grads = [np.zeros_like(w) for w in self.weights()]
        dO, db = grads[-2], grads[-1]
        dz = []
        for t in range(steps):
            z = self.O[0] @ states[0][t][3] + self.O[1] @ states[1][t][3] + self.b
            z -= z.max(axis=0)
            p = np.exp(z)
            p /= p.sum(axis=0)
            loss -= (np.log(p[y, np.arange(n)] + 1e-9) * valid[t]).sum()
            p[y, np.arange(n)] -= 1
            p *= valid[t] / count
            dz.append(p)
            dO[0] += p @ states[0][t][3].T
            dO[1] += p @ states[1][t][3].T
            db += p.sum(axis=1, keepdims=True)
        for d, unit in enumerate(self.both):
            dE, dU, dN = grads[3 * d : 3 * d + 3]
            dh = np.zeros((k, n), np.float32)
            codes, deltas = [], []
            for t in reversed(range(steps)) if d == 0 else range(steps):
                old, g, c, _ = states[d][t]
                dh = (dh + self.O[d].T @ dz[t]) * valid[t]
                z, r = g[:k], g[k:]
                da_n = dh * (1 - z) * (1 - c * c)
                back = unit.N.T @ da_n
                dN += da_n @ (r * old).T
                da_g = np.concatenate([dh * (old - c) * z * (1 - z), back * old * r * (1 - r)])
                dU += da_g @ old.T
                codes.append(x[t])
                deltas.append(np.concatenate([da_g, da_n]))
                dh = dh * z + back * r + unit.U.T @ da_g
            code = np.concatenate(codes)
            for row, delta in enumerate(np.concatenate(deltas, axis=1)):
                dE[row] = np.bincount(code, delta, 256)
        return float(loss / count), grads

    def fit(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray, steps: int = EPOCH_STEPS, batch: int = BATCH, rate: float = RATE) -> float:
        """Adam over the columns in random order, `steps` batches and all columns at least; the same result for the same
        columns. Returns the last losses' mean."""
        rng = np.random.default_rng(5)
        steps = max(steps, -(-len(y) // batch))
        order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-steps * batch // len(y)))])
        weights = self.weights()
        first, second, losses = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], []
        for i in range(1, steps + 1):
            pick = order[(i - 1) * batch : i * batch]
            loss, grads = self.gradients(x[:, pick], valid[:, pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            lr = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            for w, g, a, b in zip(weights, grads, first, second, strict=True):
                g *= min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= lr * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)
        return float(np.mean(losses[-20:]))

    def pool(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean probabilities (texts, languages) over the letter positions of each whole text."""
        x, length, of = segments([t or b"" for t in texts])
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        full = length == STEPS
        for pick in (np.flatnonzero(full), np.flatnonzero(~full)):
            for at in range(0, len(pick), WIDTH):
                cols = pick[at : at + WIDTH]
                part = np.ascontiguousarray(x[cols].T)
                valid = None if full[cols[0]] else (np.arange(STEPS)[:, None] < length[cols]).astype(np.float32)
                p = self.probabilities(part, valid)
                n = (_PART[part] if valid is None else _PART[part] * valid).sum(axis=0)
                for k in range(len(self.langs)):
                    sums[:, k] += np.bincount(of[cols], p[k], len(texts))
                counts += np.bincount(of[cols], n, len(texts))
        return sums / np.maximum(counts, 1)[:, None]


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in segments: bytes (segments, STEPS), the number of bytes in each, and the text it is of."""
    size = np.array([len(t) for t in texts])
    n = -(-size // STEPS)
    out = np.zeros((int(n.sum()), STEPS), np.uint8)
    flat, first = out.reshape(-1), np.concatenate(([0], np.cumsum(n)))
    for i, t in enumerate(texts):
        flat[first[i] * STEPS : first[i] * STEPS + len(t)] = np.frombuffer(t, np.uint8)
    of = np.repeat(np.arange(len(texts)), n)
    return out, np.minimum(STEPS, size[of] - (np.arange(len(of)) - first[of]) * STEPS), of


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Network | None:
    """The network, fitted on at most `rows` rows of each language and `size` bytes, or a row of each; None where no row has one."""
    use = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & (F.octet_length("text") <= size) & ~held_out(F.col("doc_id")))
    n_langs = use.agg(F.count_distinct("lang")).first()[0]
    ids = use.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"), F.octet_length("text").cast("long").alias("_b"))
    ids = ids.groupBy("lang", "doc_id", "_h").agg(F.min(F.struct("_t", "_b")).alias("x")).select("lang", "doc_id", "_h", "x.*")  # an id that repeats counts once
    ids = ids.withColumn("_part", F.pmod("_h", F.lit(SALT)))
    # The first rows by hash: within salted parts, and among those.
    for parts in (["lang", "_part"], ["lang"]):
        ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy("_h", "doc_id"))).where(F.col("_n") <= rows)
    so_far = F.sum("_b").over(Window.partitionBy("lang").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    ids = ids.withColumn("_sum", so_far).where((F.col("_n") == 1) | (F.col("_sum") <= size // max(1, n_langs)))
    texts = use.withColumn("_t", F.xxhash64("text")).join(small(ids.select("lang", "doc_id", "_t")), ["lang", "doc_id", "_t"])
    texts = texts.dropDuplicates(["lang", "doc_id"]).orderBy("lang", "doc_id")  # at most `rows` of each language now
    sample = texts.select("lang", F.col("text").cast("binary").alias("text")).collect()
    parts = [(r["lang"], bytes(r["text"])) for r in sample if r["text"]]
    if not parts:
        return None
    langs = sorted({lang for lang, _ in parts})
    net = Network(langs)
    x, length, of = segments([p for _, p in parts])
    net.fit(np.ascontiguousarray(x.T), (np.arange(STEPS)[:, None] < length).astype(np.float32), np.array([langs.index(lang) for lang, _ in parts])[of])
    return net


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Every row of `docs` with held_out, lang_pred and score."""
    keep = [c for c in docs.columns if c not in ADDED]
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, rows))

    def start():
        net = held.value

        def step(texts):
            if net is None:
                return [["und"] * len(texts), [0.0] * len(texts)]
            p = net.pool(texts)
            best = p.argmax(axis=1)
            known = [has_letter(t) for t in texts]
            return [[net.langs[b] if k else "und" for b, k in zip(best, known)], [min(1.0, float(p[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]]

        return step

    out = map_texts(docs, keep, "lang_pred string, score double", start)
    return out.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
