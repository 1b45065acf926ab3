"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet into the
shared folder and rereads as the next stage's docs. All but the last keep the columns of documents.
Rows with nulls, empty texts and repeated ids are handled as the operators' docstrings say; a stage on
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, packing, pii, quality, simhash
from tallyspark.llm.common import stored, table

#: Key of the surrogates; a deployment sets its own secret.
PII_KEY = "tallyspark-surrogates"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble accepts; it learns from the labelled training documents."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts linked by a 5-word Jaccard similarity of 0.8 or more, that of its smallest doc_id."""
    return simhash.representatives(docs, shingle_words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the text."""
    out = pii.pseudonymised(docs, PII_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.packed(docs, packing.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("surrogates", pii_stage),
    ("packing", packing_stage),
]

#: Rules fitted to labels, XXH64, keyed surrogates and token ids have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
