"""Sinks (K1 to K12, K14): files that other tools read. Missing values become N/A only here."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.operators import prefix
from contactmill.operators.analytics import lead_filter
from contactmill.operators.scoring import tier_label

# Header of the contact table.
COLUMNS = {
    "name": "Name", "email": "Email", "email_status": "Email Status", "role": "Role", "fund": "Fund", "focus_areas": "Focus Areas", "stage": "Stage", "check_size": "Check Size", "location": "Location",
    "linkedin": "LinkedIn", "website": "Website", "lead_score": "Lead Score", "tier": "Tier", "source": "Source", "scraped_at": "Scraped At",
}


def presented(df: DataFrame, extra: list[str] = (), plain: list[str] = ()) -> DataFrame:
    """K1: columns and spellings of the contact table; lists joined by "; "; extra columns only if some row has one; `plain` as they are."""
    kinds = dict(df.dtypes)

    def show(c: str):
        if kinds[c].startswith("array"):
            return F.array_join(c, "; ")
        if c == "tier":
            return tier_label(F.col(c))
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    some = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in extra]).first() if extra else {}
    return df.select(*plain, *[show(c).alias(h) for c, h in COLUMNS.items() if c in df.columns], *[show(c).alias(c) for c in extra if some[c]])


def write_csv(df: DataFrame, path: str, extra: list[str] = ()) -> None:
    """K1, K5: best score first."""
    presented(df.orderBy(F.desc("lead_score"), "name"), extra).write.mode("overwrite").csv(path, header=True)


def write_checkpoint(df: DataFrame, folder: str, phase: str) -> DataFrame:
    """K6: the rows after a phase, stored and read again."""
    df.write.mode("overwrite").parquet(f"{folder}/{phase}")
    return df.sparkSession.read.parquet(f"{folder}/{phase}")


def append_metrics(df: DataFrame, path: str) -> None:
    """K7: stage rows and a total for each run."""
    total = df.groupBy("run_id").agg(F.max("timestamp").alias("timestamp"), F.lit("total").alias("stage"), F.round(F.sum("duration_s"), 2).alias("duration_s"), F.max("lead_count").alias("lead_count"), F.sum("error_count").alias("error_count"))
    df.unionByName(total).write.mode("append").parquet(path)


def hot_messages(df: DataFrame, least: int = 80, size: int = 5) -> DataFrame:
    """K9: all hot leads in messages of five, best first."""
    return prefix.chunks(df.where(F.col("lead_score") >= least), [F.desc("lead_score"), "name", "fund"], size)


def upload_batches(df: DataFrame, order: list[str], size: int = 100, rename: dict[str, str] | None = None) -> DataFrame:
    """Fields renamed for the receiver, all rows in numbered batches."""
    return prefix.chunks(df.withColumnsRenamed(rename or {}), order, size)


def write_pages(df: DataFrame, path: str, order: list[Column | str], size: int = 1000, extra: list[str] = (), **filters) -> None:
    """K5: the filtered rows as CSV in pages of `size`, one after another in the order of the whole table. A file holds whole
    pages; each row has its page, so a reader takes pages up to any number without the rest."""
    pages = prefix.chunks(lead_filter(df, **filters), order, size, "page")
    names = [f.name for f in presented(df.limit(0)).schema]
    rows = pages.select("page", *[F.col(c) for c in df.columns])
    out = presented(rows.repartitionByRange("page").sortWithinPartitions("page", *order), extra, ["page"])
    out.select("page", *names, *[c for c in extra if c in out.columns]).write.mode("overwrite").csv(path, header=True)


def write_targets(df: DataFrame, path: str) -> None:
    """One address of each host, sorted."""
    df.groupBy("domain").agg(F.min("url").alias("value")).select("value").orderBy("value").write.mode("overwrite").text(path)


def write_config(spark: SparkSession, text: str, path: str) -> None:
    """A small file that readers see whole or not at all: written beside its place, then renamed onto it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, temp = hadoop.Path(path), hadoop.Path(f"{path}.{uuid4().hex}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(temp)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # A plain rename fails where the target exists; this one replaces it in one step.
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context = hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(temp), files.makeQualified(target), options)


def read_config(spark: SparkSession, path: str) -> str:
    """The file's text."""
    return spark.read.text(path, wholetext=True).first()[0]
