"""The queries op1 to op13 over the test tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.session import workers_can_import

from . import alignment, chat_format, lang_gru, line_runs, mixing, oracles, quality_fm, rule_ledger, secret_index, setsketch, token_counts, token_store, vector_codes, winnow
from .common import cut, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return workers_can_import(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(mixing.sized(table(spark, sf_dir, "documents")))
    return mixing.decide(rows, mixing.plan(rows)).select("doc_id", "size", "source_size", "target", "taken")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "token-store")
    token_store.write_store(docs, folder, vocabulary())
    return token_store.read_store(spark, folder)


def op4_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_gru.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return rule_ledger.apply_policy(rows).select("doc_id", *rule_ledger.MEASURES[:5], "base_failed", "kept", "failed")


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_index.report(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_fm.classify(docs.select("doc_id", "text", "n_chars"), labels).select("doc_id", "held_out", "score", "predicted")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return winnow.decontaminate(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


def op13_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    stored = chat_format.write_examples(table(spark, sf_dir, "conversations").select(*more.columns).union(more), new_folder(spark, "chat"))
    return chat_format.report_examples(stored)


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_token_attribution": op2_token_attribution,
    "op3_token_store": op3_token_store,
    "op4_byte_gru": op4_byte_gru,
    "op5_setsketch": op5_setsketch,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_line_runs": op7_line_runs,
    "op8_trigram_secrets": op8_trigram_secrets,
    "op9_factorisation_machine": op9_factorisation_machine,
    "op10_winnowing": op10_winnowing,
    "op11_alignment": op11_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_targets": op13_prefix_targets,
}
SQL = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
