"""Small vocabularies and strings that queries use, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import simple_sections
from .duck import quote

_LEXICON = [
    # parser, entity_class, idx, default_label, syn, case_sensitive, confidence, annotation_score
    ("lex_a", "function", "A1", "the", "the", False, 50, 3),
    ("lex_a", "function", "A2", "of", "of", False, 50, 1),
    ("lex_a", "function", "A3", "and", "and", False, 50, 2),
    ("lex_a", "function", "A4", "The", "The", True, 100, 2),
    ("lex_a", "symbol", "A5", "it", "it", False, 10, 1),
    ("lex_a", "symbol", "A6", "it pronoun", "it", False, 10, 7),
    ("lex_a", "symbol", "A7", "it other", "it", False, 10, 7),
    ("lex_a", "insult", "A8", "idiot", "idiot", False, 100, 4),
    ("lex_a", "insult", "A9", "clown", "clown", False, 100, 5),
    ("lex_a", "insult", "A10", "loser", "loser", False, 50, 6),
    ("lex_b", "link", "B1", "of the", "of the", False, 100, 2),
    ("lex_b", "link", "B2", "in the", "in the", False, 100, 4),
    ("lex_b", "link", "B3", "and", "and", False, 10, 5),
    ("lex_b", "function", "B4", "the article", "the", False, 100, 9),
    ("lex_b", "gene", "B5", "on", "on", False, 100, 1),
    ("lex_b", "gene", "B6", "to the", "to the", False, 50, 1),
    ("lex_b", "gene", "B7", "that", "that", True, 50, 1),
    ("lex_b", "gene", "B8", "with", "with", False, 10, 3),
    ("lex_b", "place", "B9", "de la", "de la", False, 50, 3),
    ("lex_b", "place", "B10", "der", "der", False, 50, 8),
    ("lex_b", "place", "B11", "der article", "der", False, 50, 2),
]


def _literal(v) -> str:
    return quote(v) if isinstance(v, str) else str(v).lower()


LEXICON = (
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in _LEXICON)
    + ") AS lex(parser, entity_class, idx, default_label, syn, case_sensitive, confidence, annotation_score)"
)

_STRINGS = (
    "MOP-2", "y(+)L-type amino acid transporter 1", "mTOR", "erbB2", "egfr(-)", "C0D0C4J1X3", "JAK2", "MPNs", "TESTIN gene",
    "Chromosome X", "type II diabetes", "factor VIII", "a/b, c", "TNF-α", "NF-κB", "interferon γ", "antibodies", "mosquitoes", "switches",
    "apoptosis", "ERBBs", "HIV", "flu", "NSCLC", "Insulin", "insulin receptors", "vitamin A", "B cell", "phase I", "phase V trial", "Acme", "ACME LTD",
    "BRCA1/2/3", "D8/17", "left lung", "IL 6", "TYPE I collagen", "x", "", " two  spaces ",
)

STRINGS = f"""SELECT p_name AS s FROM part UNION SELECT s_name AS s FROM supplier UNION SELECT text AS s FROM benchmark
  UNION SELECT * FROM (VALUES {", ".join(f"({quote(s)})" for s in _STRINGS)}) AS more(s)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s: the distinct strings of ``STRINGS``."""
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("s")) for t, c in (("part", "p_name"), ("supplier", "s_name"), ("benchmark", "text"))]
    more = spark.createDataFrame([(s,) for s in _STRINGS], "s string")
    return parts[0].union(parts[1]).union(parts[2]).union(more).distinct()


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.sql(LEXICON)


def dictionary(spark: SparkSession) -> DataFrame:
    return lexicon(spark).select("parser", "entity_class", F.upper("syn").alias("syn_norm"), F.col("syn").alias("text"), "case_sensitive", "confidence")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_sections(table(spark, sf_dir, "documents"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a vocabulary: names are shared by many ids, so they are ambiguous."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit("parts").alias("parser"), F.lit("product").alias("entity_class"), F.col("p_partkey").cast("string").alias("idx"),
        F.col("p_name").alias("default_label"), F.col("p_name").alias("syn"), F.col("p_type").alias("mapping_type"),
        F.col("p_brand").alias("source"), F.col("p_size").alias("annotation_score"),
    )
