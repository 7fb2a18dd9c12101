"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import decontaminate, fingerprints, htmltext, langid, mixing, neardup, negatives, pii, toxicity, urlfilter, vectors, warc, whitening
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents by id and epoch."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars", "epoch")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.held_out("doc_id", 4, 2)
    model = langid.train(docs, train=F.col("doc_id").isNotNull() & ~held)
    return langid.predict(docs, model, held=held)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.report(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.held_out("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), train=~held)
    return toxicity.score(docs, model, held=held)


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation, exact in the operator, as a long; null where it is larger than one (from half a million rows on, for the vectors given)."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows)).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.report(table(spark, sf_dir, "documents"))
    joined = lambda name: F.array_join(name, "")
    return found.select("doc_id", "n_chars", "edited_sha256", joined("sketch").alias("fingerprint"), joined("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next", "in_edited", "in_next")


_ALL = (op1_decontaminate, op2_mixing, op3_warc, op4_langid, op5_html, op6_pii, op7_neardup, op8_vectors, op9_toxicity, op10_urlfilter, op11_whitening, op12_negatives, op13_fingerprints)
QUERIES = {f.__name__: f for f in _ALL}
