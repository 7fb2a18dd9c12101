"""A corpus from documents: toxic texts out, near-duplicates and contaminated texts out, personal data masked, sources mixed.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of documents, extra ones too whatever their names; the last adds the epoch.

Null and empty texts are no one's copies, toxic only if the model's prior is, clean of benchmarks and personal data, and chosen with full epochs.
Null ids are kept by every stage and train nothing. Of rows with one id and text one stays; of a group of near-duplicates the one with the
least id. Very long texts are handled whole. Empty documents give an empty corpus; empty labels call nothing toxic, an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorweave.llm import common, decontaminate, langid, mixing, neardup, pii, toxicity
from sensorweave.session import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is predicted toxic; labels are learned as in op9, never from held-out ids."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), train=~langid.held_out("doc_id", 5, 0))
    return toxicity.keep(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates."""
    return neardup.keep(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lie in benchmark windows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents by the weights of domains, languages and sources; a row for each epoch a document is in."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

#: No SQL expresses a trained field or the classes of signatures; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs)
    return docs
