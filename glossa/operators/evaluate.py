"""Accuracy of mentions and links against gold annotations, and consistency of annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_pairs(gold: DataFrame, test: DataFrame) -> DataFrame:
    """Gold and test mentions of a section and class that agree: equal spans, or an end of the gold span
    lies in the test span (ends count, so touching agrees). Both need id, doc_id, section_idx, start, end, entity_class."""
    on = ["doc_id", "section_idx", "entity_class"]
    g = gold.select(*on, F.col("id").alias("gold_id"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    t = test.select(*on, F.col("id").alias("test_id"), F.col("start").alias("ts"), F.col("end").alias("te"))
    return g.join(t, on).filter("(gs between ts and te) or (ge between ts and te)")


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    """(precision, recall), 0 where there is nothing to divide."""
    zero = F.lit(0.0)
    return F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)


def ner_accuracy(gold: DataFrame, test: DataFrame, strict: bool = True) -> DataFrame:
    """entity_class, tp, fp, fn, precision, recall.

    Not strict: classes without any prediction in a section aren't scored there.
    """
    if not strict:
        gold = gold.join(test.select("doc_id", "section_idx", "entity_class").distinct(), ["doc_id", "section_idx", "entity_class"], "left_semi")
    met = _agreements(gold, test)
    is_gold, hit = F.col("is_gold"), F.col("hit")
    count = lambda c: F.count(F.when(c, 1))
    both = met.groupBy("entity_class").agg(count(is_gold & hit).alias("tp"), count(~is_gold & ~hit).alias("fp"), count(is_gold & ~hit).alias("fn"))
    p, r = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.select("entity_class", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))


def _agreements(gold: DataFrame, test: DataFrame) -> DataFrame:
    """entity_class, is_gold, hit of all mentions: whether ``span_pairs`` has the mention in some pair.

    Mentions are sorted within a section and class instead of paired. A gold end lies in a test span iff the
    furthest end of the test spans that begin before it reaches it; a test span holds a gold end iff the next one
    from its start is in it.
    """
    on = ["doc_id", "section_idx", "entity_class"]
    rows = lambda df, is_gold: df.select(*on, "start", "end", F.lit(is_gold).alias("is_gold"))
    out = rows(gold, True).unionByName(rows(test, False))
    hit = F.lit(False)
    for end in ("start", "end"):
        # Of a gold mention this end, of a test mention its start.
        out = out.withColumn(f"at_{end}", F.when(F.col("is_gold"), F.col(end)).otherwise(F.col("start")))
        at, w = F.col(f"at_{end}"), Window.partitionBy(*on)
        reach = F.max(F.when(~F.col("is_gold"), F.col("end"))).over(w.orderBy(at, "is_gold").rowsBetween(Window.unboundedPreceding, 0))
        following = F.min(F.when(F.col("is_gold"), at)).over(w.orderBy(at.desc(), F.desc("is_gold")).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"met_{end}", F.when(F.col("is_gold"), reach >= at).otherwise(following <= F.col("end")))
        hit = hit | F.coalesce(f"met_{end}", F.lit(False))
    known = F.col("doc_id").isNotNull() & F.col("section_idx").isNotNull() & F.col("entity_class").isNotNull()
    return out.select("entity_class", "is_gold", (hit & known).alias("hit"))


def link_accuracy(gold: DataFrame, test: DataFrame) -> DataFrame:
    """source, tp, fp, fn, precision, recall of (mention, source, idx) sets."""
    on = ["mention", "source", "idx"]
    g, t = gold.select(*on).distinct().withColumn("g", F.lit(1)), test.select(*on).distinct().withColumn("t", F.lit(1))
    both = g.join(t, on, "full_outer").groupBy("source").agg(
        F.count(F.when(F.col("g").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("g").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("t").isNull(), 1)).alias("fn"),
    )
    p, r = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.withColumn("precision", p).withColumn("recall", r)


def mean_f1(accuracy: DataFrame) -> DataFrame:
    """mean_f1: the plain mean of 2PR / (P + R) over classes; 0 as soon as a class has none."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return accuracy.select(f1.alias("f1")).agg(F.when(F.min("f1") == 0, 0.0).otherwise(F.avg("f1")).alias("mean_f1"))


def acceptance(accuracy: DataFrame, thresholds: DataFrame, key: str = "entity_class") -> DataFrame:
    """key, passed: whether precision and recall reach their thresholds (key, min_precision, min_recall)."""
    return accuracy.join(F.broadcast(thresholds), key).select(
        key, ((F.col("precision") >= F.col("min_precision")) & (F.col("recall") >= F.col("min_recall"))).alias("passed")
    )


def require(accepted: DataFrame) -> DataFrame:
    """The same rows, but the job fails on the first that didn't pass."""
    return accepted.filter(F.expr("assert_true(passed, 'accuracy below its threshold') is null"))


def consistency(mentions: DataFrame) -> DataFrame:
    """match, n, n_classes, n_mapping_sets for strings that are annotated in several ways or have an odd length.

    ``mentions``: match, entity_class, mapping_set (a key of the mention's identifiers).
    """
    return (
        mentions.groupBy("match")
        .agg(F.count("*").alias("n"), F.countDistinct("entity_class").alias("n_classes"), F.countDistinct("mapping_set").alias("n_mapping_sets"))
        .withColumn("odd_length", F.length("match") < 2)
        .filter("n_classes > 1 or n_mapping_sets > 1 or odd_length")
    )
