"""Whole jobs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import checkpointed
from ..plans.annotate import default_pipeline
from .fixtures import lexicon, table
from .ner import MENTIONS


def _kb(spark: SparkSession) -> DataFrame:
    return lexicon(spark).withColumn("mapping_type", F.lit("exact"))


def annotate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default job over all documents: one mention per place, after linking and cleanup."""
    job = default_pipeline(_kb(spark), class_order=("link", "gene", "function"), max_tokens=2, cut=checkpointed)
    done = job(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.mentions.select("doc_id", "section_idx", "start", "end", "match", "entity_class", "confidence")


def annotate_ner_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = default_pipeline(_kb(spark), max_tokens=2)
    done = job(table(spark, sf_dir, "documents").select("doc_id", "text"), group="ner_only")
    return done.mentions.groupBy("entity_class").agg(F.count("*").alias("n"))


CATALOGUE = {
    "annotate_documents": (annotate_documents, None),
    "annotate_ner_only": (annotate_ner_only, MENTIONS + " SELECT entity_class, count(*) AS n FROM mentions GROUP BY entity_class"),
}
