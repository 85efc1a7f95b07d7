"""The operators applied to whole test tables, with the digest columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm import align, audit, decontaminate, editprint, lm, mixing, pii, quality, shared, simhash, substrings, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc_bundles")
def _(spark, sf_dir):
    facts = warc.archived(spark, table(spark, sf_dir, "pages"), shared.new_path(spark, "archives"))
    return facts.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op2_source_mix")
def _(spark, sf_dir):
    served = mixing.scheduled(table(spark, sf_dir, "documents"))
    in_service_order = served.orderBy(F.col("passes")[0]["finish"], "doc_id")
    return in_service_order.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_lm_scores")
def _(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


@query("op4_quality_resampling")
def _(spark, sf_dir):
    drawn = quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select(F.col("doc").alias("doc_id"), "n_grams", "weight", "score", "kept")


@query("op5_repeated_passages")
def _(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op6_edit_fingerprints")
def _(spark, sf_dir):
    return editprint.edit_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_simhash_groups")
def _(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op8_token_counts")
def _(spark, sf_dir):
    import public_tokenizers

    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op9_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_exact", "n_misspelled")


@query("op10_benchmark_overlaps")
def _(spark, sf_dir):
    return decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_personal_data")
def _(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def _(spark, sf_dir):
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.alignments(table(spark, sf_dir, "documents"), *files)


@query("op13_filter_audit")
def _(spark, sf_dir):
    return audit.audit_files(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
