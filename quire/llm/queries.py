"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.context_mixing import score_texts
from quire.llm.exact_dedup import ORACLE as COPIES_SQL
from quire.llm.exact_dedup import mark
from quire.llm.filter_audit import ORACLE as AUDIT_SQL
from quire.llm.filter_audit import audit
from quire.llm.mixing import mix
from quire.llm.order_minhash import fingerprint_edits, to_text
from quire.llm.packing import near_copies, pack
from quire.llm.pii import find
from quire.llm.quality_model import score_quality
from quire.llm.quality_rules import ORACLE as RULES_SQL
from quire.llm.quality_rules import apply_rules
from quire.llm.simhash import hex16, simhash_groups
from quire.llm.tokens import count_tokens
from quire.llm.toxicity import score_toxicity
from quire.llm.whitening import whiten


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, 4 differing bits at most."""
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every text and of its edited text (2-word k-mers, tuples of 2, 64 bins)."""
    r = fingerprint_edits(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    to_text(F.col("sig")).alias("fingerprint"), to_text(F.col("edited_sig")).alias("edited_fingerprint"),
                    "near_edited", "near_next")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: sources weigh 5, 2, 1, repeating."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; no bin holds two near copies (SimHash) or more than two pieces of a source."""
    docs = table(spark, sf_dir, "documents")
    p = pack(docs, texts=False, classes=near_copies(docs))
    return p.select("doc_id", "source", "cluster", "piece", "piece_words", "bin_id", "bin_words")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under the 50k byte-level BPE vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the verdict of the line rules."""
    r = apply_rules(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base patterns, and what the skip-chain field adds."""
    r = find(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                    F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; ids with crc32 modulo 3 = 1 are held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; ids with crc32 modulo 4 = 2 are held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text; ids with crc32 modulo 5 = 1 teach nothing."""
    return score_texts(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest id stays."""
    return mark(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of five filters for each source, order and step."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_order_minhash": op2_order_minhash,
    "op3_source_mixing": op3_source_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_line_quality_rules": op7_line_quality_rules,
    "op8_pii_skip_chain": op8_pii_skip_chain,
    "op9_toxicity_weak_supervision": op9_toxicity_weak_supervision,
    "op10_context_mixing_lm": op10_context_mixing_lm,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_quality_rules": RULES_SQL,
    "op11_exact_dedup": COPIES_SQL,
    "op13_filter_audit": AUDIT_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
