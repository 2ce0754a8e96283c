"""Cross-tokenizer alignment: groups and links between two tokenizers' tokens of the same bytes.

Each text is encoded by a byte-level vocabulary (A, as a space and the text) and by a piece vocabulary (B, which adds that
space itself). A token is stored as one long, its end in bytes times 2^SHIFT plus its id, and an end as the mark that sorts behind
its token: the greatest id. From there on Spark's functions on arrays find the groups: `array_intersect` of the two end arrays gives
the ends that both share, which, put in place by sorting longs, cut either side into groups. An Arrow step reads the cut arrays
out: the groups as text for the digest, and of each group the last tokens, which end together and are its link. (`aggregate` would
copy an array that it builds at each step, n^2 for a text of n tokens; a `sequence` of group numbers, and `transform` over tokens
and groups, cost more than half of the time. None of them is used.)

Links are counted by id pair over the whole corpus, at most once a document and pair through the shuffle. The table of counts
is broadcast only where a count shows it to be small, else documents' pairs meet it by a shuffled join.

Null and empty texts, and texts whose tokens of A or of B don't spell the space and the text (such as one that holds U+2581,
which B takes for a space), have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Null ids and
repeated rows are allowed, and each row counts; empty input gives empty output. Other columns pass through; an input column
with the name of an added one is replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from hashlib import sha256
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, small
from .encoding import _byte_letters

SHIFT = 20
MARK = (1 << SHIFT) - 1
#: Pairs of ids whose counts may be broadcast, 24 bytes each.
BROADCAST_PAIRS = 1_000_000
#: Tokens and marks that a Python worker holds as words at once, and bytes of a batch, one longer row aside.
PART_TOKENS, BATCH_BYTES = 250_000, 8 << 20
ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Bytes:
    """A: a byte-level vocabulary, its strings of special tokens plain text.

    Its merges are numbered like the tokens that they make (looked up when it is loaded), so that a token's number is its rank, and
    `tiktoken`, which merges by rank, gives the ids of `tokenizers` in a third of the time. Its split by pattern can't
    take very long runs of white space, which are left to `tokenizers`.
    """

    #: Fixed value: the pattern of byte-level vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LONG = 50_000

    def __init__(self, path: str) -> None:
        import tiktoken

        given = json.loads(Path(path).read_text(encoding="utf-8"))
        model, split = given["model"], given["pre_tokenizer"]
        tokens = {k: i for k, i in model["vocab"].items() if i not in {t["id"] for t in given["added_tokens"]}}
        assert split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not given["normalizer"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        assert sorted(tokens.values()) == list(range(256 + len(pairs))) and all(tokens[a + b] == 256 + i for i, (a, b) in enumerate(pairs))
        letters = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(letters[c] for c in k): i for k, i in tokens.items()}
        self.path, self.library = path, None
        self.fast = tiktoken.Encoding("a", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(len(ranks), np.int64)
        for k, i in ranks.items():
            self.size[i] = len(k)

    def _whole(self, text: str) -> list[int]:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a space and the text."""
        spaced = " " + text
        slow = len(text) >= self.LONG and re.search(rf"\s{{{self.LONG}}}", spaced)
        return np.array(self._whole(spaced) if slow else self.fast.encode_ordinary(spaced), np.int64)


class Pieces:
    """B: a piece vocabulary."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # Texts aren't normalised, and what no piece spells is spelt by bytes: so only U+2581 changes, and a text's length with it.
        assert b"\x0a\x08identity" in self.model.serialized_model_proto() and sum(map(self.model.is_byte, range(len(pieces)))) == 256
        self.size = np.array([1 if self.model.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.model.encode(texts, num_threads=1, return_type="numpy")


class Both:
    """Ids of whole texts in both vocabularies."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Bytes(path_a), Pieces(path_b)
        assert max(len(self.a.size), len(self.b.size)) < MARK

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each text the ids of A and those of B; none where either doesn't spell the space and the text, or the text is empty."""
        nothing = np.zeros(0, np.int64)
        a, b = [self.a.encode(t) if t else nothing for t in texts], self.b.encode(texts) if texts else []
        for i, t in enumerate(texts):
            n = 1 + len(t.encode())
            if not t or int(self.a.size[a[i]].sum()) != n or int(self.b.size[b[i]].sum()) != n:
                a[i] = b[i] = nothing
        return a, b


@cache
def _encoder(path_a: str, path_b: str) -> Both:
    """One for all tasks of a worker."""
    return Both(path_a, path_b)


def _lists(ids: list[np.ndarray], size: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Of each text the marks of its tokens' ends, and its tokens: end times 2^SHIFT plus MARK, or plus id."""
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(count)))
    ends = np.concatenate(([0], np.cumsum(size[flat])))
    ends = ends[1:] - np.repeat(ends[at[:-1]], count)
    offsets = pa.array(at, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array((ends << SHIFT) | MARK)), pa.ListArray.from_arrays(offsets, pa.array((ends << SHIFT) | flat))


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every row of `docs` (any columns, and text) without its text, with a_ends, a, b_ends and b: of each token its end in bytes times 2^SHIFT plus MARK, and plus its id."""
    keep = [c for c in docs.columns if c != "text"]
    # Arrays without nulls, which Spark sorts and intersects as plain numbers.
    added = [T.StructField(n, T.ArrayType(T.LongType(), False), False) for n in ("a_ends", "a", "b_ends", "b")]
    schema = T.StructType([*docs.select(*keep).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _encoder(path_a, path_b)
        for batch in batches:
            for part in slices(batch):
                ids = both.encode([t or "" for t in part.column("text").to_pylist()])
                made = [x for side, v in enumerate((both.a, both.b)) for x in _lists(ids[side], v.size)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], names=[*keep, *[f.name for f in added]])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has many more than PART_TOKENS tokens and marks, whole rows only."""
    size = np.cumsum(sum(np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in ("_a", "_b")))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _side(marked: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of one side: ids and marks, the places of the marks, and where each row begins among the marks."""
    ids = marked.flatten().to_numpy() & MARK
    marks = np.flatnonzero(ids == MARK)
    offsets = marked.offsets.to_numpy()
    return ids, marks, np.searchsorted(marks, offsets - offsets[0])


def _words(size: int) -> pa.StringArray:
    """Each id below `size`, each behind another of its group, the end of A's side of a group, and that of B's."""
    return pa.array([*map(str, range(size)), *(f",{i}" for i in range(size)), "|", ";"])


def written(rows: DataFrame) -> DataFrame:
    """Rows with _a and _b, each side's tokens with a mark behind each group, with groups_sha256 and `links` instead: the digest of
    the groups' written form, empty where there are none, and of each group the pair of its last ids, which end together."""
    keep = [c for c in rows.columns if c not in ("_a", "_b")]
    link = T.StructType([T.StructField(c, T.IntegerType(), False) for c in "ab"])
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("groups_sha256", T.StringType(), False), T.StructField("links", T.ArrayType(link, False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << 16
        words = _words(size)
        for part in (p for batch in batches for p in _pieces(batch)):
            (a, ends_a, row), (b, ends_b, _) = (_side(part.column(c)) for c in ("_a", "_b"))
            last = [a[ends_a - 1], b[ends_b - 1]]
            most = max((int(x[x != MARK].max(initial=0)) for x in (a, b)))
            if most >= size:
                size = 1 << most.bit_length()
                words = _words(size)
            # Groups in order, A's words of each before B's.
            n_a, n_b = np.diff(ends_a, prepend=-1), np.diff(ends_b, prepend=-1)
            start = np.concatenate(([0], np.cumsum(n_a + n_b)))
            word = np.empty(start[-1], np.int64)
            for ids, ends, n, at, sign in ((a, ends_a, n_a, start[:-1], 2 * size), (b, ends_b, n_b, start[:-1] + n_a, 2 * size + 1)):
                first = ends - n + 1
                ids += size
                ids[first] -= size
                ids[ends] = sign
                word[np.arange(len(ids)) + np.repeat(at - first, n)] = ids
            text = words.take(pa.array(word))
            cuts = np.frombuffer(text.buffers()[1], np.int32, len(word) + 1)[start[row]].tolist() if len(word) else [0] * len(row)
            raw = memoryview(text.buffers()[2] or b"")
            digest = [sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in pairwise(cuts)]  # without the last sign
            pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in last], fields=[pa.field(c, pa.int32(), False) for c in "ab"])
            links = pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(digest, pa.string()), links], names=[*keep, "groups_sha256", "links"])

    return rows.select(*keep, "_a", "_b").mapInArrow(run, schema)


def align(rows: DataFrame) -> DataFrame:
    """Rows of `tokens` with n_a, n_b, n_groups, groups_sha256 and `links`, a pair of ids (a, b) for each group.

    Steps without a lambda are selects of their own, used more than once so that Spark keeps them apart: there they are compiled, and
    longs are sorted as such."""
    keep = [c for c in rows.columns if c not in ("a_ends", "a", "b_ends", "b")]
    rows = rows.withColumn("_marks", F.array_intersect("a_ends", "b_ends"))
    rows = rows.select(*keep, F.size("_marks").alias("_n"), F.sort_array(F.concat("a", "_marks")).alias("_a"), F.sort_array(F.concat("b", "_marks")).alias("_b"))
    tokens_of = lambda c: (F.size(c) - F.col("_n")).cast("long")
    return written(rows.select(*keep, tokens_of("_a").alias("n_a"), tokens_of("_b").alias("n_b"), F.col("_n").cast("long").alias("n_groups"), "_a", "_b"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches between Spark and Python of about BATCH_BYTES, for what runs meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_best(n: DataFrame) -> DataFrame:
    """Counts (a, b, count) of pairs with `best`: whether no other a has more with its b."""
    most = n.groupBy("b").agg(F.max("count").alias("most"))  # one row an id of B
    return n.join(small(most, MARK), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, keep: list[str] | None = None) -> DataFrame:
    """Every row of `docs`, of its columns `keep` or all, with its numbers of tokens, groups and links, how many links have
    their B id's most frequent pair, the sum of its links' counts, and the digest of its groups."""
    keep = [c for c in keep or docs.columns if c not in ADDED]
    scratch = Scratch(docs.sparkSession, "alignment")
    # What passes through is one struct, so that no name clashes with an inner one.
    found = align(tokens(docs.select(F.struct(*keep).alias("_doc"), "text"), path_a, path_b))
    with small_batches(docs.sparkSession):
        rows = scratch.put("rows", found.withColumn("_row", F.monotonically_increasing_id()))
    links = rows.select("_row", F.explode("links").alias("pair")).select("_row", "pair.a", "pair.b")
    counts = scratch.put("counts", with_best(scratch.put("n", links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")))))
    scratch.drop("n")
    if counts.count() <= BROADCAST_PAIRS:
        each = links.join(F.broadcast(counts), ["a", "b"]).withColumn("n", F.lit(1).cast("long"))
    else:
        each = links.groupBy("_row", "a", "b").agg(F.count(F.lit(1)).alias("n")).join(counts, ["a", "b"])
    sums = each.groupBy("_row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    given = [c if c in ("n_a", "n_b", "n_groups", "groups_sha256") else F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ADDED]
    return rows.drop("links").join(sums, "_row", "left").select("_doc.*", *given)
