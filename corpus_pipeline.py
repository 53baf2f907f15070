"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the
last keep the columns of ``documents``.  A stage bounds the batches of the session
that it runs in, as its result is computed where it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from muster.llm import decontaminate, line_dedup, near_dedup, packing, quality
from muster.llm.queries import table, vocabulary
from muster.llm.storage import bound_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learnt decision list keep."""
    bound_batches(spark)
    return quality.keep_good(docs, quality.rules_from(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; a document of which no word is left goes."""
    bound_batches(spark)
    return line_dedup.drop_later_lines(docs, drop_emptied=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates, on five-word shingles."""
    bound_batches(spark)
    return near_dedup.keep_first(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    bound_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    bound_batches(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("best_fit_packing", packing_stage),
]
#: Learnt rules and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
