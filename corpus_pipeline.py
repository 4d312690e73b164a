"""The corpus pipeline: classify, apply rules, drop near copies, cut repeats, pack into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tiltmeter.llm import classifier, near_duplicates, packing, quality_rules, suffix_dedup
from tiltmeter.llm.common import INNER, stored
from tiltmeter.llm.queries import documents, vocabulary

SHINGLE_WORDS = 5
SIMILARITY = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, fitted on the labelled ones among them, scores at 0.3 or more."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(classifier.score(model, F.col("text")) >= classifier.THRESHOLD)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the word rules and the compression bands keep."""
    return docs.filter(quality_rules.quality_rules(F.col("text"))["kept"])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies; of repeated rows of one id, one."""
    found = near_duplicates.near_duplicates(docs, shingle_words=SHINGLE_WORDS, similarity=SIMILARITY)
    most = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    kept = found.filter("kept").select(F.col("doc_id").alias(f"{INNER}kept"))
    if (most or 0) > 1:
        kept, docs = kept.distinct(), docs.dropDuplicates(["doc_id", "text"])
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[f"{INNER}kept"]), "left_semi")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes of strings that also start earlier; n_chars follows the text."""
    return suffix_dedup.remove_repeats(docs).drop("repeats").withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence for every token piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores, compression ratios and the packing search are beyond SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)  # later stages read their rows several times
    return docs
