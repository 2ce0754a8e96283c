"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: a word is a run of characters outside these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a broadcast table may have; every broadcast here goes through `small`.
BROADCAST_ROWS = 20_000
#: Rows of a scratch table of narrow rows that share a file, where their number is known.
FILE_ROWS = 50_000
#: Rows of any width that are worth a file of their own.
LEAST_ROWS = 2_000
#: Characters of text that a Python worker holds as words at once, one longer text aside.
SLICE_CHARS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or, in one process only, one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = "file://" + tempfile.mkdtemp(prefix="contactmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, stored in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows: int, each: int = LEAST_ROWS) -> DataFrame:
    """`df`, of about so many rows, in no more partitions than they fill with `each`, or than two for each core, where shuffles have
    more than that. Its rows are dealt out once more then: the tasks that compute them stay as they are, only those that
    store them are few. (For each file a local file system of Hadoop's starts several processes.)"""
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))
    return df.repartition(n) if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > n else df


class Scratch:
    """Tables of a job in many steps, in a folder of the shared one. Storing a table under a name again deletes the
    version before; shuffle files go once the driver's garbage is collected, which is asked for then too."""

    def __init__(self, spark: SparkSession, kind: str) -> None:
        self.spark, self.folder, self.count, self.at = spark, new_folder(spark, kind), 0, {}

    def put(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The same rows without their lineage, read from Parquet. `rows`: about how many there are, all narrow; they are then
        stored in no more files than they fill, or than two for each core, however many partitions hold them. (For each file a
        local file system of Hadoop's starts several processes.)"""
        self.count += 1
        if rows is not None:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        path = f"{self.folder}/{name}-{self.count}"
        df.write.parquet(path)
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for path in filter(None, (self.at.pop(n, None) for n in names)):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        gc.collect()
        self.spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count proves that `df` has at most `rows` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds much more text than SLICE_CHARS, whole rows only."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, keep: list[str], added: str, start, extra: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns `keep` of `df` and the columns `added` (a DDL schema), computed from whole texts in Arrow batches.

    `start()` is called once a task and returns a function from a list of texts (bytes, None for null), and a list of
    values for each column of `extra`, to one list or Arrow array for each added column. Rows keep their order.
    """
    extra = extra or []
    schema = T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(added).fields])
    columns = [*keep, *[c for c in (*extra, text) if c not in keep]]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in to_arrow_schema(schema)][len(keep) :]
        step = start()
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).cast(pa.binary() if part.schema.field(text).type == pa.string() else pa.large_binary()).to_pylist()
                found = step(texts, *[part.column(c).to_pylist() for c in extra])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, types, strict=True)]], names=names)

    return df.select(*columns).mapInArrow(run, schema)
