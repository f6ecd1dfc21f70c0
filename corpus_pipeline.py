"""The training-data pipeline over ``documents``: five stages, each on all that the one before kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ties, other columns (left out) and an empty
table (no rows). Every stage but the last returns the columns of ``documents``. ``run`` writes each stage's result to the shared folder and
reads it back, as a job would. No SQL expresses stages 2, 4 and 5, so there is none for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import minhash, mixing, packing, quality_cnn, quality_rules
from tidewright.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from the texts; documents that the rules reject go. Null and empty texts have no words and go; a
    null source is a host of its own; repeated rows share a verdict and count once."""
    return quality_rules.clean(docs.select(*COLUMNS))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of what came in, scores below its threshold go. Null and empty texts
    are scored, too; labels that are null or of unknown ids teach nothing; without labels all score 0.5 and stay."""
    model = quality_cnn.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality_cnn.good(docs.select(*COLUMNS), model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.
    Texts without words stay, those of one id and text once; a row without an id goes only for a near copy of its own text."""
    return minhash.deduplicated(docs.select(*COLUMNS), width=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. A null source is a source of its own, last in order; texts without words add
    no words; equal rows are taken alike."""
    return mixing.mix(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null or empty text is the end id alone; null ids are packed like others."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
