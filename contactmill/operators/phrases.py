"""Which phrases of a table stand in which texts.

The phrases become one automaton in which every text is read once, whatever their number: a trie whose fail links lead from
each prefix to the longest other prefix that ends it. It is built once, kept in flat arrays, and sent to the executors
where the phrases' count and length, looked at first, allow it. A larger table is cut into parts by hash, each within the
bound, and the texts are read once for each part. Nothing is paired with what it doesn't contain.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of the phrases of one automaton: about 16 bytes of arrays a letter.
MOST_LETTERS = 4_000_000


class Automaton:
    """Nodes are numbered breadth first, so a node's children are neighbours: `first[n]` to `first[n + 1]` in order of their letter.

    `fail`: the node of the longest end of a node's letters that is a beginning of a phrase; `hit`: the nearest node on the way of fails,
    itself included, that ends a phrase (0: none); `next_hit`: the one after that; `phrase`: the phrase that a node ends (-1: none).
    """

    def __init__(self, phrases: list[str]) -> None:
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        for i, p in enumerate(phrases):
            at = 0
            for c in p:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                at = nxt
            ends[at] = i
        n = len(children)
        number, order, queue = [0] * n, [0], deque([0])
        letters, first = [0] * n, np.zeros(n + 1, np.int32)
        while queue:
            old = queue.popleft()
            first[number[old]] = len(order)
            for c in sorted(children[old]):
                child = children[old][c]
                number[child] = len(order)
                letters[len(order)] = ord(c)
                order.append(child)
                queue.append(child)
        first[n] = n
        self.first, self.letter = first, np.array(letters, np.int32)
        self.phrase = np.full(n, -1, np.int32)
        for old, i in ends.items():
            self.phrase[number[old]] = i
        self.fail, self.next_hit, self.hit = (np.zeros(n, np.int32) for _ in range(3))
        for parent in range(n):
            for child in range(first[parent], first[parent + 1]):
                c, at = int(self.letter[child]), int(parent)
                fail = 0
                while at:
                    at = int(self.fail[at])
                    found = self._child(at, c)
                    if found:
                        fail = found
                        break
                self.fail[child] = fail
                self.next_hit[child] = self.hit[fail]
                self.hit[child] = child if self.phrase[child] >= 0 else self.hit[fail]

    def _child(self, at: int, c: int) -> int:
        """The child by a letter; 0 if there is none, as the root is nobody's child."""
        lo, hi = int(self.first[at]), int(self.first[at + 1])
        i = lo + int(np.searchsorted(self.letter[lo:hi], c))
        return i if i < hi and self.letter[i] == c else 0

    def found(self, text: str) -> set[int]:
        """Numbers of the phrases in a text."""
        go, fail, hit, next_hit, phrase = self._tables()
        at, out = 0, set()
        for c in text:
            step = go[at].get(c)
            while step is None and at:
                at = fail[at]
                step = go[at].get(c)
            at = step or 0
            h = hit[at]
            while h:
                i = phrase[h]
                if i in out:
                    break  # and what ends it as well
                out.add(i)
                h = next_hit[h]
        return out

    def _tables(self):
        """The arrays as lists, and the children as maps, made when a task first reads a text."""
        if not hasattr(self, "_made"):
            first, letters = self.first.tolist(), [chr(c) for c in self.letter.tolist()]
            go = [dict(zip(letters[a:b], range(a, b))) for a, b in zip(first, first[1:])]
            self._made = go, self.fail.tolist(), self.hit.tolist(), self.next_hit.tolist(), self.phrase.tolist()
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def _read(texts: DataFrame, keep: list[str], text: str, automaton: Automaton, names: list[str]) -> DataFrame:
    spark = texts.sparkSession
    given = spark.sparkContext.broadcast((automaton, names))
    schema = T.StructType([*texts.select(*keep).schema.fields, T.StructField("phrase", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, phrases = given.value
        for batch in batches:
            rows, hits = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                for p in sorted(made.found(t)) if t else ():
                    rows.append(i)
                    hits.append(phrases[p])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], pa.array(hits, pa.string())], names=[*keep, "phrase"])

    return texts.select(*keep, text).mapInArrow(run, schema)


def phrase_hits(texts: DataFrame, phrases: DataFrame, keep: list[str], text: str = "text", phrase: str = "phrase", fold: bool = True, most: int = MOST_LETTERS) -> DataFrame:
    """(the columns `keep` of `texts`, the columns of `phrases`) of every text and every phrase in it, once each; letters of
    either case are equal if `fold`. Null and empty phrases and null texts hit nothing; repeated rows of either side count."""
    lower = (lambda c: F.lower(c)) if fold else (lambda c: c)
    mine = phrases.withColumn("_key", lower(F.col(phrase))).where("_key != ''")
    distinct = mine.select("_key").distinct()
    letters = distinct.agg(F.sum(F.length("_key"))).first()[0] or 0
    parts = max(1, -(-letters // most))
    rows = texts.select(*keep, lower(F.col(text)).alias("_text"))
    out = None
    for i in range(parts):
        # One part's phrases: within the bound but for chance.
        names = sorted(r[0] for r in distinct.where(F.pmod(F.xxhash64("_key"), F.lit(parts)) == i).collect())
        got = _read(rows, keep, "_text", Automaton(names), names)
        out = got if out is None else out.union(got)
    hits = out.withColumnRenamed("phrase", "_hit")
    return hits.join(mine, F.col("_hit") == F.col("_key")).drop("_hit", "_key")
