"""Token-id output: shards of raw ids, each with a minimal perfect hash index from document key to offset.

Documents are range-partitioned and sorted by id (nulls first; rows that repeat an id by their text's hash), so shards
follow each other in ascending order. There are as many shards as shuffle partitions, and more where a shard would hold
much more than SHARD_CHARS characters. Rows that repeat id and text, or have neither, are dealt to several shards. A shard
is three files in a folder that all machines reach, numbers little-endian:

    *.ids  8 bytes "CMILLIDS", uint32 version, uint32 bytes an id (2 or 4); then the ids, documents one after another
    *.mph  the index: "CMILLMPH", uint32 version, uint32 levels, uint64 slots, uint64 bytes of each level; the levels' bits;
           uint32 number of ones before each of their bytes; then a record a slot (SLOT): fingerprint, number of
           documents, offset of their first id, number of their first document
    *.doc  what reading in sequence needs: a record a document (DOC): has an id, id, number of token ids

The hash function is a cascade of bit arrays: at each level every remaining key names a bit, and keys alone on their bit
stay; a key's slot is the rank of its bit. A lookup reads one byte a level, two levels in the mean, then the slot's record,
whatever the shard's size; an absent key is taken for a present one with probability 2^-32. Keys that repeat are neighbours
in the file and share a slot; documents without id are reached by position only. Files are written under a name of their
own for each attempt and listed in the manifest by the attempt that succeeded, so a repeated task does no harm.

Null text is encoded as empty; every document ends with the end id. Columns other than id and text aren't stored, whatever
their names. Rows that repeat are stored as often as they come. An empty table gives a store without documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .encoding import encoder

MAGIC, INDEX_MAGIC, VERSION, HEAD = b"CMILLIDS", b"CMILLMPH", 2, 16
GAMMA = 1.6
READ_IDS, READ_DOCS = 1 << 21, 1 << 16
SHARD_CHARS = 1 << 28
SLOT = np.dtype([("print", "<u4"), ("docs", "<u4"), ("offset", "<i8"), ("first", "<i8")])
DOC = np.dtype([("known", "?"), ("key", "<i8"), ("size", "<i8")])
MANIFEST = "pid int, ids string, first long, last long, n_docs long, n_ids long"


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0..n-1, without storing keys. `byte` and `rank` read one place of the bits and of the counts before it."""

    def __init__(self, sizes: list[int], byte, rank) -> None:
        self.sizes, self.byte, self.rank = sizes, byte, rank
        self.first = [0, *np.cumsum(sizes).tolist()]

    @staticmethod
    def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Bytes of each level, all bits, and the ones before each byte."""
        left, bits = keys.astype(np.uint64), []
        while len(left):
            size = -(-int(len(left) * GAMMA + 1) // 8) * 8
            at = (mixed(left, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone))
            left = left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.empty(0, np.uint8)
        ones = np.bitwise_count(flat).astype(np.int64)
        return [len(b) for b in bits], flat, (np.cumsum(ones) - ones).astype("<u4")

    @classmethod
    def held(cls, keys: np.ndarray) -> PerfectHash:
        sizes, flat, ranks = cls.build(keys)
        return cls(sizes, flat.__getitem__, ranks.__getitem__)

    def slot(self, key: int) -> int:
        """Slot of a key; -1 for some keys that are not in the set, any slot for others."""
        one = np.array([key], np.int64)
        for level, size in enumerate(self.sizes):
            at = int(mixed(one, level)[0] % np.uint64(size * 8))
            place, bit = self.first[level] + at // 8, at % 8
            byte = int(self.byte(place))
            if byte >> (7 - bit) & 1:
                return int(self.rank(place)) + (byte >> (8 - bit)).bit_count()
        return -1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return np.array([self.slot(k) for k in keys.tolist()], np.int64)


def _fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; Spark itself spells local ones file:/..."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return mixed(keys, 1 << 20).astype(np.uint32)


def _write_index(name: str, docs: np.ndarray) -> None:
    """The index and the documents (DOC) of a shard."""
    start = np.cumsum(docs["size"]) - docs["size"]
    known = np.flatnonzero(docs["known"])
    distinct, first, runs = np.unique(docs["key"][known], return_index=True, return_counts=True)
    sizes, bits, ranks = PerfectHash.build(distinct)
    out = np.zeros(len(distinct), SLOT)
    slot = _slots(distinct, sizes, bits, ranks)
    out["print"][slot], out["docs"][slot], out["offset"][slot], out["first"][slot] = _fingerprints(distinct), runs, start[known][first], known[first]
    head = INDEX_MAGIC + np.array([VERSION, len(sizes)], "<u4").tobytes() + np.array([len(distinct), *sizes], "<u8").tobytes()
    for kind, parts in (("mph", (head, bits.tobytes(), ranks.tobytes(), out.tobytes())), ("doc", (docs.tobytes(),))):
        store, at = _fs(f"{name}.{kind}")
        with store.open_output_stream(at) as f:
            for p in parts:
                f.write(p)


def _slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slots of all keys of the set at once."""
    out, open_, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = (mixed(keys[open_], level) % np.uint64(size * 8)).astype(np.int64)
        byte, bit = first + at // 8, at % 8
        hit = (bits[byte] >> (7 - bit).astype(np.uint8)) & 1 == 1
        byte, bit = byte[hit], bit[hit]
        out[open_[hit]] = ranks[byte].astype(np.int64) + np.bitwise_count(bits[byte] >> (8 - bit).astype(np.uint16)).astype(np.int64)
        open_, first = open_[~hit], first + size
    return out


class Shard:
    """Keyed and sequential reading of one shard."""

    def __init__(self, ids: str) -> None:
        self.name = ids.removesuffix(".ids")
        store, at = _fs(ids)
        self.file = store.open_input_file(at)
        head = self.file.read_at(HEAD, 0)
        if head[:8] != MAGIC or np.frombuffer(head, "<u4", 1, 8)[0] != VERSION:
            raise ValueError(f"{ids} is no shard of this version")
        self.kind = np.dtype(f"<u{np.frombuffer(head, '<u4', 1, 12)[0]}")
        store, at = _fs(f"{self.name}.mph")
        self.index = store.open_input_file(at)
        head = self.index.read_at(24, 0)
        if head[:8] != INDEX_MAGIC:
            raise ValueError(f"{self.name}.mph is no index")
        levels = int(np.frombuffer(head, "<u4", 1, 12)[0])
        sizes = np.frombuffer(self.index.read_at(8 * levels, 24), "<u8").tolist()
        bits = 24 + 8 * levels
        ranks = bits + sum(sizes)
        self.records = ranks + 4 * sum(sizes)
        self.hash = PerfectHash(sizes, lambda i: self.index.read_at(1, bits + i)[0], lambda i: np.frombuffer(self.index.read_at(4, ranks + 4 * i), "<u4")[0])
        store, at = _fs(f"{self.name}.doc")
        self.docs = store.open_input_file(at)

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * self.kind.itemsize, HEAD + start * self.kind.itemsize), self.kind)

    def sizes(self, first: int, n: int) -> np.ndarray:
        """The documents' records (DOC)."""
        return np.frombuffer(self.docs.read_at(n * DOC.itemsize, first * DOC.itemsize), DOC)

    def find(self, key: int) -> np.void | None:
        """The key's record (SLOT); None where the fingerprint says that there is none."""
        slot = self.hash.slot(key)
        if slot < 0:
            return None
        got = np.frombuffer(self.index.read_at(SLOT.itemsize, self.records + slot * SLOT.itemsize), SLOT)[0]
        return got if got["print"] == _fingerprints(np.array([key], np.int64))[0] else None

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of each document with this key, end id included."""
        at = self.find(key)
        if at is None:
            return []
        size = self.sizes(int(at["first"]), int(at["docs"]))["size"]
        ids = self.ids(int(at["offset"]), int(size.sum()))
        return np.split(ids, np.cumsum(size)[:-1])

    def documents(self) -> Iterator[tuple[np.ndarray, list[int]]]:
        """All documents in file order, some at a time: their records (DOC) and the crc32 of each one's ids as uint32."""
        first = start = 0
        while len(docs := self.sizes(first, READ_DOCS)):
            at = 0
            ends = np.cumsum(docs["size"])
            while at < len(docs):
                base = int(ends[at] - docs["size"][at])
                end = max(at + 1, int(np.searchsorted(ends, base + READ_IDS, "right")))
                part = docs[at:end]
                ids = self.ids(start + base, int(part["size"].sum())).astype("<u4")
                yield part, [zlib.crc32(ids[b - base - n : b - base]) for b, n in zip(ends[at:end].tolist(), part["size"].tolist())]
                at = end
            first, start = first + len(docs), start + int(ends[-1])


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids below `folder`; returns the manifest, one row a shard, which is stored there too."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // SHARD_CHARS)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p"))
    rows = rows.repartitionByRange(shards, "doc_id", "h", "p").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        name = f"{folder}/shard-{pid:06d}-{uuid4().hex}"
        parts: list[np.ndarray] = []
        out = held = None
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    held = encoder(path)
                    store, at = _fs(f"{name}.ids")
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at)
                    out.write(MAGIC + np.array([VERSION, held.kind.itemsize], "<u4").tobytes())
                    end = np.array([end_id], held.kind).tobytes()
                rows = np.zeros(part.num_rows, DOC)
                keys = part.column("doc_id").cast(pa.int64())
                rows["known"], rows["key"] = np.array(keys.is_valid()), np.array(keys.fill_null(0))
                sizes = []
                for ids in held.encode([t or "" for t in part.column("text").to_pylist()]):
                    out.write(ids.tobytes() + end)
                    sizes.append(len(ids) + 1)
                rows["size"] = sizes
                parts.append(rows)
        if out is not None:
            out.close()
            made = np.concatenate(parts)
            _write_index(name, made)
            real = made["key"][made["known"]]
            row = [[pid], [f"{name}.ids"], [int(real[0]) if len(real) else None], [int(real[-1]) if len(real) else None], [len(made)], [int(made["size"].sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4))], names=["pid", "ids", "first", "last", "n_docs", "n_ids"])

    done = cut(rows.mapInArrow(run, MANIFEST))  # one row a shard
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done.withColumn("before", before).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(f"{folder}/manifest")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for row in p.itertuples():
                start = row.before
                for docs, sums in Shard(row.ids).documents():
                    size = docs["size"]
                    at = start + np.cumsum(size) - size
                    start += int(size.sum())
                    yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(docs["key"].copy(), ~docs["known"]), "start": at, "n_tokens": size, "ids_crc32": np.array(sums, np.int64)})

    n = max(1, shards.count())
    return shards.repartition(n).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the documents with given keys: one read of the manifest's rows for all keys, then some bytes of the shards'
    indexes and the documents' own ids."""
    out: dict[int, list[np.ndarray]] = {k: [] for k in keys}
    if not keys:
        return out
    rows = spark.read.parquet(f"{folder}/manifest").where((F.col("first") <= max(keys)) & (F.col("last") >= min(keys))).orderBy("pid").collect()
    for r in rows:
        mine = [k for k in out if r["first"] <= k <= r["last"]]
        shard = Shard(r["ids"]) if mine else None
        for k in mine:
            out[k] += shard.get(k)
    return out
