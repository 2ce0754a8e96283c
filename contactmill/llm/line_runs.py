"""Line dedup over a suffix array of line ids; DataFrame functions only.

Lines are the \\n-split lines that hold a word, numbered from 0 within their document; a document's order is its id (null
last), then a hash of id and text. Lines that occur once can't be in a repeat, so they end the sequences they stand in;
the others are numbered by rank. Prefix doubling sorts the suffixes of all sequences: in round j a suffix gets its rank
by its first 2^j lines, from its own rank and that of the suffix 2^(j-1) lines on. A rank is the number of suffixes that
sort before, so equal ranks are an interval of the suffix array whose longest common prefix is 2^j lines or more. Rank and interval
size also say about where a pair of ranks will sort, which deals the pairs evenly to buckets that each sort their own
part; nothing is sorted in one place, and a very common line is spread by what follows it.

The suffixes that share their first n lines are an interval of the suffix array whose longest common prefix is n or more,
named by two overlapping ranks. Of every run of at least `min_words` words that gets shorter than that without its first
line, or without its last line, this interval is looked up; doubling so ends at the longest such run, since deeper ranks would only order
within intervals. A run that is not the first of its interval is a later copy, and all its lines are deleted. In a maximal repeated run of `min_words` words
or more, the shortest run from a line to the right covers the line if it fits, else the shortest run that ends at the last
line does; both repeat where the maximal run does. So every maximal run is deleted whole, but for its first copy; copies
within one document count.

Null and empty texts have no lines. Rows that repeat id and text are one document and share the result. Null ids and
empty input are allowed. `deduplicated` passes other columns through and replaces `text`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut
from .rule_ledger import let

MIN_WORDS = 50
#: Parts in which suffixes are sorted: so many at least, and one for so many lines.
BUCKETS, LINES_A_BUCKET = 256, 4_000_000
_ANY = r"[^\x20\x09-\x0D]"


def _keys(docs: DataFrame) -> list[Column]:
    """did and dk: the document's order and identity, never null."""
    text = F.md5(F.coalesce(docs["text"], F.lit("")))
    key = F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), text))
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("did"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("dk")]


def _lines(docs: DataFrame) -> Column:
    return F.filter(F.split(F.coalesce(docs["text"], F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(_ANY)))


def _ranked(groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Groups (keys, n, x) of `total` suffixes with r: the number of suffixes in groups before. x in [0, 1) rises with the keys."""
    parts = max(BUCKETS, total // LINES_A_BUCKET)
    g = groups.withColumn("bucket", F.least(F.floor(F.col("x") * parts), F.lit(parts - 1)).cast("int"))
    sums = g.groupBy("bucket").agg(F.sum("n").alias("size"))  # at most `parts` rows
    sums = sums.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("offset"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.join(F.broadcast(sums), "bucket").withColumn("r", F.col("offset") + before).drop("bucket", "offset", "x")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, dk, start, end): the runs of lines to delete, end inclusive."""
    exploded = docs.select(*_keys(docs), F.posexplode(_lines(docs)).alias("pos", "line"))
    rows = cut(exploded.select("did", "dk", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("nw")))
    ids = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = ids.agg(F.sum("n")).first()[0]
    if not total:
        return rows.select("did", "dk", F.col("pos").alias("start"), F.col("pos").alias("end")).where("false")
    ids = _ranked(ids.withColumn("x", F.shiftrightunsigned(F.col("h1").bitwiseXOR(F.lit(-(2**63))), 11) / float(2**53)), ["h1", "h2"], total)
    rows = rows.join(ids.select("h1", "h2", "r", F.col("n").alias("c")), ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["did", "dk", "pos"])
    doc = Window.partitionBy("did", "dk").orderBy("pos")
    rows = rows.withColumn("seg", F.col("pos") - F.row_number().over(doc))
    rows = cut(_run_lengths(rows, min_words).withColumn("names", F.array("r")))
    longest = rows.agg(F.max("top")).first()[0] or 0
    run, h = Window.partitionBy("did", "dk", "seg").orderBy("pos"), 1
    while 2 * h <= longest:
        pairs = cut(rows.withColumn("b", F.coalesce(F.lead("r", h).over(run) + 1, F.lit(0))))
        x = (F.col("r") + F.col("c") * (F.col("b") / float(total + 1))) / float(total)
        rows = cut(pairs.join(_next(pairs, x, total), ["r", "b"]).select("did", "dk", "seg", "pos", "w", "top", F.col("r2").alias("r"), F.col("c2").alias("c"), F.concat("names", F.array("r2")).alias("names")))
        h *= 2
    level = F.floor(F.log2(F.col("w") + 0.5)).cast("int")
    at = rows.where("w is not null").withColumn("w", F.explode(F.sequence("w", "top"))).select("did", "dk", "pos", "w", level.alias("j"), F.get("names", level).alias("one"), (F.col("pos") + F.col("w") - F.pow(F.lit(2), level).cast("int")).alias("q"))
    there = rows.select("did", "dk", F.col("pos").alias("q"), F.col("names").alias("names_q"))
    at = at.join(there, ["did", "dk", "q"]).select("did", "dk", "pos", "w", "one", F.get("names_q", F.col("j")).alias("two"))
    at = cut(at)
    # Stored, so that a run of very many copies is no more than a skewed side of a join to Spark.
    first = cut(at.groupBy("w", "one", "two").agg(F.min(F.struct("did", "dk", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    at = at.join(first, ["w", "one", "two"])
    later = at.where(F.struct("did", "dk", "pos") != F.col("first")).groupBy("did", "dk", "pos").agg(F.max(F.col("pos") + F.col("w") - 1).alias("to"))
    # Lines under any later copy, then their islands.
    covered = rows.select("did", "dk", "pos").join(later, ["did", "dk", "pos"], "left").withColumn("reach", F.max("to").over(doc)).where("reach >= pos")
    islands = covered.withColumn("island", F.col("pos") - F.row_number().over(doc))
    return islands.groupBy("did", "dk", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("island")


def _next(pairs: DataFrame, x: Column, total: int) -> DataFrame:
    """(r, b) to the next round's rank r2 and interval size c2."""
    groups = pairs.groupBy("r", "b").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c")).withColumn("x", x)
    ranked = _ranked(groups.select(F.col("r").alias("r1"), "b", "n", "x"), ["r1", "b"], total)
    return ranked.select(F.col("r1").alias("r"), "b", F.col("r").alias("r2"), F.col("n").alias("c2"))


def _run_lengths(rows: DataFrame, min_words: int) -> DataFrame:
    """Lines (did, dk, seg, pos, nw, ...) with how many lines make min_words words (w; null if all to the sequence's end
    are fewer), and how many lines the longest run from there has that gets shorter than min_words without its first line,
    or w if that is more (top; null like w)."""
    seg = Window.partitionBy("did", "dk", "seg")
    lines = rows.withColumn("upto", F.sum("nw").over(seg.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.max("pos").over(seg))
    # Goals among the running sums: a line's goal is reached at the first sum that isn't below it, the last seen when read downwards.
    at = F.struct(F.col("upto").alias("v"), F.lit(0).alias("goal"), F.col("pos").alias("at"))
    goal = F.struct((F.col("upto") - F.col("nw") + min_words).alias("v"), F.lit(1).alias("goal"), F.lit(None).cast("int").alias("at"))
    both = lines.withColumn("e", F.explode(F.array(at, goal)))
    down = seg.orderBy(F.desc("e.v"), "e.goal").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("end", F.last("e.at", ignorenulls=True).over(down)).where("e.goal = 1")
    top = F.coalesce(F.lead("end").over(seg.orderBy("pos")) - F.col("pos"), F.col("last") - F.col("pos") + 1)
    both = both.withColumn("w", F.col("end") - F.col("pos") + 1).withColumn("top", F.greatest("w", F.when(F.col("w").isNotNull(), top)))
    return both.select("did", "dk", "seg", "pos", "r", "c", "w", "top")


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_lines, n_deleted, n_runs, runs (start-end, comma-joined)."""
    runs = deleted_lines(docs, min_words).groupBy("did", "dk").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n_deleted"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("a"))
    rows = docs.select("doc_id", *_keys(docs), F.size(_lines(docs)).cast("long").alias("n_lines"))
    text = F.array_join(F.transform(F.col("a"), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = rows.join(runs, ["did", "dk"], "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_deleted", F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("n_runs"), F.coalesce(text, F.lit("")).alias("runs"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the later copies' lines cut from `text`; lines without a word stay."""
    runs = deleted_lines(docs, min_words).groupBy("did", "dk").agg(F.collect_list(F.struct("start", "end")).alias("_runs"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(docs)).join(runs, ["did", "dk"], "left")

    def left(lines: Column) -> Column:
        """The lines but those in the runs, which count lines with a word only."""
        all_ = F.sequence(F.lit(0), F.size(lines) - 1)
        full = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(_ANY)), i)), lambda i: i.isNotNull())
        gone = let(full, lambda f: F.flatten(F.transform("_runs", lambda r: F.slice(f, r["start"] + 1, r["end"] - r["start"] + 1))))
        return F.array_join(F.transform(F.array_except(all_, gone), lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("_runs").isNull(), F.col("row.text")).otherwise(let(F.split("row.text", "\n"), left))
    return rows.select("row", text.alias("_t")).select(*[F.col("_t").alias("text") if c == "text" else F.col(f"row.{c}") for c in docs.columns])
