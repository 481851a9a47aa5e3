"""Accuracy against gold annotations, consistency, reports, and nested output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import evaluate as V
from ..sources import documents as D
from .fixtures import sections, table
from .ner import MENTIONS, mapped, mentions


def _gold_and_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold: the lexicon's mentions. Test: those of most strings, some with another class or a longer span."""
    m = mentions(spark, sf_dir).withColumn("id", F.concat_ws("|", "doc_id", "start", "end", "entity_class"))
    gold = m.select("id", "doc_id", "section_idx", "start", "end", "entity_class")
    kept = m.filter("confidence > 10 or start % 3 <> 0")
    cls = F.when(F.col("start") % 11 == 0, "other").otherwise(F.col("entity_class"))
    test = kept.select("id", "doc_id", "section_idx", "start", F.when(F.col("start") % 5 == 0, F.col("end") + 2).otherwise(F.col("end")).alias("end"), cls.alias("entity_class"))
    return gold, test


_EVAL = MENTIONS + """, gold AS (SELECT doc_id || '|' || s || '|' || e || '|' || entity_class AS id, doc_id, s, e, entity_class FROM mentions),
test AS (SELECT doc_id || '|' || s || '|' || e || '|' || entity_class AS id, doc_id, s, CASE WHEN s % 5 = 0 THEN e + 2 ELSE e END AS e,
  CASE WHEN s % 11 = 0 THEN 'other' ELSE entity_class END AS entity_class FROM mentions WHERE confidence > 10 OR s % 3 <> 0),
pairs AS (SELECT g.id AS gold_id, t.id AS test_id FROM gold g JOIN test t ON g.doc_id = t.doc_id AND g.entity_class = t.entity_class
  AND ((g.s BETWEEN t.s AND t.e) OR (g.e BETWEEN t.s AND t.e))),
a AS (SELECT entity_class, count(*) FILTER (id IN (SELECT gold_id FROM pairs)) AS tp, count(*) FILTER (id NOT IN (SELECT gold_id FROM pairs)) AS fn FROM gold GROUP BY ALL),
b AS (SELECT entity_class, count(*) FILTER (id NOT IN (SELECT test_id FROM pairs)) AS fp FROM test GROUP BY ALL),
acc AS (SELECT entity_class, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn,
  coalesce(tp / nullif(coalesce(tp, 0) + coalesce(fp, 0), 0), 0.0) AS precision, coalesce(tp / nullif(coalesce(tp, 0) + coalesce(fn, 0), 0), 0.0) AS recall
  FROM a FULL JOIN b USING (entity_class))"""


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ner_accuracy(*_gold_and_test(spark, sf_dir))


def ner_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _accuracy(spark, sf_dir)
    return a.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def mean_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _accuracy(spark, sf_dir).filter("entity_class <> 'other'")
    return V.mean_f1(known).select(F.round("mean_f1", 6).alias("mean_f1"))


_LIMITS = [("gene", 0.8, 0.8), ("function", 0.9, 0.99), ("link", 0.5, 0.5), ("insult", 0.8, 0.95)]


def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(_LIMITS, "entity_class string, min_precision double, min_recall double")
    return V.acceptance(_accuracy(spark, sf_dir), limits)


def link_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' suppliers against those of the lines of the first half of the order lines."""
    li = table(spark, sf_dir, "lineitem")
    rows = lambda df: df.select(F.col("l_orderkey").alias("mention"), F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("idx"))
    out = V.link_accuracy(rows(li.filter("l_linenumber <= 3")), rows(li.filter("l_linenumber >= 2")))
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


_LINK_SQL = """WITH g AS (SELECT DISTINCT l_orderkey AS m, l_returnflag AS source, l_suppkey AS i FROM lineitem WHERE l_linenumber <= 3),
t AS (SELECT DISTINCT l_orderkey AS m, l_returnflag AS source, l_suppkey AS i FROM lineitem WHERE l_linenumber >= 2),
c AS (SELECT source, count(*) FILTER (g.m IS NOT NULL AND t.m IS NOT NULL) AS tp, count(*) FILTER (g.m IS NULL) AS fp, count(*) FILTER (t.m IS NULL) AS fn
  FROM g FULL JOIN t USING (source, m, i) GROUP BY source)
SELECT source, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c"""


def annotation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    maps = mapped(spark, m).groupBy("ent_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("parser", F.lit(":"), "idx"))), ",").alias("mapping_set"))
    return V.consistency(m.join(maps, "ent_id", "left").withColumn("mapping_set", F.coalesce("mapping_set", F.lit("")))).drop("odd_length")


_CONSISTENCY_SQL = MENTIONS + """, ms AS (SELECT m.doc_id, m.s, m.e, m.entity_class, m.match,
  coalesce(array_to_string(list_sort(list(DISTINCT parser || ':' || idx) FILTER (idx IS NOT NULL)), ','), '') AS mapping_set
  FROM mentions m LEFT JOIN lex ON lower(m.match) = lower(lex.syn) AND m.entity_class = lex.entity_class AND (NOT case_sensitive OR m.match = lex.syn)
  GROUP BY m.doc_id, m.s, m.e, m.entity_class, m.match)
SELECT match, count(*) AS n, count(DISTINCT entity_class) AS n_classes, count(DISTINCT mapping_set) AS n_mapping_sets FROM ms GROUP BY match
HAVING count(DISTINCT entity_class) > 1 OR count(DISTINCT mapping_set) > 1 OR length(match) < 2"""


def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: of each the turn with the longest text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return C.dedupe_largest(c, "conv_id", F.length("text"))


def class_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that several parsers or classes annotate: how often, by whom."""
    m = mentions(spark, sf_dir)
    return m.groupBy(F.lower("match").alias("low")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity_class")), "|").alias("classes")
    ).filter("instr(classes, '|') > 0")


def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_json(sections(spark, sf_dir), mentions(spark, sf_dir))


def render_annotation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.annotation_tasks(sections(spark, sf_dir), mentions(spark, sf_dir))


def render_brat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.brat_lines(mentions(spark, sf_dir))


CATALOGUE = {
    "ner_accuracy": (ner_accuracy, _EVAL + " SELECT entity_class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM acc"),
    "mean_f1": (
        mean_f1,
        _EVAL + """, f AS (SELECT coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM acc WHERE entity_class <> 'other')
        SELECT CASE WHEN min(f1) = 0 THEN 0.0 ELSE round(avg(f1), 6) END AS mean_f1 FROM f""",
    ),
    "acceptance_gate": (
        acceptance_gate,
        _EVAL + f""" SELECT entity_class, precision >= p AND recall >= r AS passed FROM acc
        JOIN (VALUES {", ".join(f"('{c}', {p}, {r})" for c, p, r in _LIMITS)}) AS l(entity_class, p, r) USING (entity_class)""",
    ),
    "link_accuracy": (link_accuracy, _LINK_SQL),
    "annotation_consistency": (annotation_consistency, _CONSISTENCY_SQL),
    "dedupe_documents": (
        dedupe_documents,
        "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, role, text) = 1",
    ),
    "class_conflicts": (
        class_conflicts,
        MENTIONS + """ SELECT lower(match) AS low, count(*) AS n, array_to_string(list_sort(list(DISTINCT entity_class)), '|') AS classes
        FROM mentions GROUP BY lower(match) HAVING count(DISTINCT entity_class) > 1""",
    ),
    "render_json": (render_json, None),
    "render_annotation_tasks": (render_annotation_tasks, None),
    "render_brat": (
        render_brat,
        MENTIONS + " SELECT doc_id, match || chr(9) || entity_class || chr(9) || s || chr(9) || e AS line FROM mentions",
    ),
}
