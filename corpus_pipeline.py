"""The training-data pipeline: quality, near copies, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is
written as Parquet and read again. All but the last return the columns of ``docs`` as they came,
whatever further columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm import decontaminate, mixing, quality, simhash, substrings
from verdictlake.llm.shared import saved
from verdictlake.session import configure


def body_of(docs: DataFrame) -> Column:
    """The hash of a text that tells rows of one id apart."""
    return F.xxhash64(F.coalesce(docs.text, F.lit("")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    configure(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, with the operator's own shingles and distance, the document with the smallest id stays.

    Documents without an id come after all others, those that share an id in the order of a hash of their
    text; rows repeated as they are count as one. Documents without words are alike, so one of them stays.
    """
    configure(spark)
    key = F.struct(docs.doc_id.isNull().alias("unnamed"), docs.doc_id.alias("first_id"), body_of(docs).alias("first_body"))
    groups = simhash.near_groups(docs.select(key.alias("doc_key"), docs.text.alias("text")), id="doc_key")
    first = groups.select("component_id.*").distinct()
    same = docs.doc_id.eqNullSafe(first.first_id) & (body_of(docs) == first.first_body)
    return docs.join(first.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go, as the operator decides; a document of which nothing is left goes whole.

    Texts without a repeated passage stay as they are, the others have their words joined by spaces.
    Documents that had no words before stay. A column n_chars follows the text.
    """
    configure(spark)
    cut = substrings.without_repeats(docs, keep_body=True).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("body").alias("cut_body"), "kept", "n_words", "n_removed")
    # Rows equal in id and text have one cut text.
    cut = cut.dropDuplicates(["cut_id", "cut_body"])
    same = docs.doc_id.eqNullSafe(cut.cut_id) & (body_of(docs) == cut.cut_body)
    joined = docs.join(cut.hint("shuffle_hash"), same, "left")
    left = joined.filter(cut.n_removed.isNull() | (cut.n_removed < cut.n_words))
    text = F.when(cut.n_removed.isNotNull(), cut.kept).otherwise(docs.text).alias("text")
    size = F.when(cut.n_removed.isNotNull(), F.length(cut.kept))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = size.otherwise(docs.n_chars).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*[changed.get(c, docs[c]) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark passage go."""
    configure(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words that it takes of each, in the order in which they are first served."""
    configure(spark)
    served = mixing.scheduled(docs, keep=("source",)).filter("taken > 0")
    in_order = served.orderBy(F.col("passes")[0]["finish"], "doc_id")
    return in_order.select("doc_id", F.col("mix_source").alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

#: The stages rest on fitted models and 64-bit hashes that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
