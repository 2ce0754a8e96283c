"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. A
stage works on all that the one before kept, and what it decides holds: rejected documents, copies and contaminated
documents are gone, the mix repeats or leaves out documents, and the last stage writes the token store and returns one
row for each document in it (doc_id, start, n_tokens, ids_crc32).

Any column may be null, ids may repeat, and tables may be empty; further columns of `documents`, whatever their names, pass
through all stages but the last. Each stage says what it does with nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactmill.llm import mixing, quality_fm, setsketch, token_store, winnow
from contactmill.llm.common import new_folder
from contactmill.llm.queries import table, vocabulary

#: SQL can't express the classifier, nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of 0.5 or more, exactly 0.5 included, as have all where no label
    is known. Null and empty texts are scored by their structure; repeated rows share their score and stay repeated."""
    return quality_fm.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group linked by 5-word shingles at a similarity of 0.8 or more; a similarity of
    exactly 0.8 links. Rows without id come after all ids; of rows that repeat id and text one stays, the same one each
    time. Null texts and texts without words are linked with nothing and all stay."""
    return setsketch.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark spans cover less than a twentieth; exactly a twentieth is contaminated. Null and empty texts
    are clean, and all are where the benchmark is empty. Repeated rows share their fate."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them. Null and empty texts have no words to take;
    a null source is a source of its own. Of rows that repeat id and text so many are taken as the target asks for."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, read back from its files in ascending order of id, nulls first, then of the text's hash.
    Null text is empty; a document that the mix repeats is stored as often."""
    folder = new_folder(spark, "token-store")
    token_store.write_store(docs, folder, vocabulary())
    return token_store.read_store(spark, folder)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix), ("token-ID / binary output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{stage.__name__}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
