"""Mapping strategies (which candidates a mention keeps) and disambiguation (which of their id sets).

Tables: ``links`` (key, parser, syn_norm, exact_match, search_score, match_norm, ...), one row per mention
key and candidate; ``sets`` (key, parser, set_key, idx, ...), one row per identifier of a candidate set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER = ["key", "parser"]


def exact_match(links: DataFrame) -> DataFrame:
    return links.filter(F.coalesce("exact_match", F.lit(False)))


def symbols_agree(a: Column, b: Column) -> Column:
    """Every token of the string with more tokens (ties: the second) is found in the other, each once, and
    nothing is left of it."""
    many = F.size(F.split(a, " ")) > F.size(F.split(b, " "))
    tokens, other = F.split(F.when(many, a).otherwise(b), " "), F.when(many, b).otherwise(a)
    left = F.aggregate(
        tokens,
        other,
        lambda rest, t: F.when(rest.isNull() | (F.instr(rest, t) == 0), F.lit(None).cast("string")).otherwise(
            F.concat(
                F.substring(rest, F.lit(1), F.instr(rest, t) - 1),
                F.substring(rest, F.instr(rest, t) + F.length(t), F.length(rest)),
            )
        ),
    )
    return left.isNotNull() & (F.trim(left) == "")


def symbol_match(links: DataFrame) -> DataFrame:
    return links.filter(symbols_agree(F.col("match_norm"), F.col("syn_norm")))


def subtoken_match(links: DataFrame, least: int = 3) -> DataFrame:
    """The candidate that is a word of the mention, if it alone has its length; the longest such length wins."""
    inside = F.array_contains(F.split("match_norm", " "), F.col("syn_norm")) & (F.length("syn_norm") >= least)
    hit = links.filter(inside).withColumn("len", F.length("syn_norm"))
    alone = hit.withColumn("n", F.count("*").over(Window.partitionBy(*PER, "len"))).filter("n = 1")
    return alone.withColumn("r", F.row_number().over(Window.partitionBy(*PER).orderBy(F.desc("len")))).filter("r = 1").drop("r", "n", "len")


def strong_match(links: DataFrame, threshold: float = 80.0, margin: float = 2.0, symbolic_only: bool = False) -> DataFrame:
    """Candidates scored at least the threshold and at most the margin below the best."""
    some = links.filter("search_score is not null")
    if symbolic_only:
        some = some.filter("is_symbolic")
    best = F.max("search_score").over(Window.partitionBy(*PER))
    return some.withColumn("best", best).filter((F.col("search_score") >= threshold) & (F.col("best") - F.col("search_score") <= margin)).drop("best")


def strong_match_confirmed(links: DataFrame, similarity: str = "embed_score", least: float = 0.60, **options) -> DataFrame:
    """Strong matches, the first of each id set only, that embeddings confirm. Needs set_key and the similarity."""
    w = Window.partitionBy(*PER, "set_key").orderBy(F.desc("search_score"), "syn_norm")
    return strong_match(links, **options).withColumn("r", F.row_number().over(w)).filter((F.col("r") == 1) & (F.col(similarity) >= least)).drop("r")


def defined_elsewhere(sets: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each set trimmed to the ids that the document has mapped already (doc_id, parser, idx)."""
    return sets.join(mapped.select("doc_id", "parser", "idx").distinct(), ["doc_id", "parser", "idx"], "left_semi")


def by_annotation(sets: DataFrame, scores: DataFrame) -> DataFrame:
    """The sets that hold the id with the highest annotation score (missing: 0), ties included."""
    s = sets.join(scores.select("parser", "idx", "annotation_score"), ["parser", "idx"], "left").withColumn("s", F.coalesce("annotation_score", F.lit(0)))
    per = s.groupBy(*PER, "set_key").agg(F.max("s").alias("s"))
    best = per.withColumn("r", F.rank().over(Window.partitionBy(*PER).orderBy(F.desc("s")))).filter("r = 1").select(*PER, "set_key")
    return sets.join(best, [*PER, "set_key"], "left_semi")


def by_default_label(sets: DataFrame, labels: DataFrame, norm: Column) -> DataFrame:
    """The ids whose normalised label is the mention's normal form, as one new set. Needs match_norm."""
    named = labels.select("parser", "idx", norm.alias("label_norm"))
    hit = sets.join(named, ["parser", "idx"]).filter("label_norm = match_norm")
    return hit.drop("label_norm").withColumn("set_key", F.lit("label"))


def by_similarity(sets: DataFrame, similarity: str) -> DataFrame:
    """The ids at the highest similarity, as one new set."""
    w = Window.partitionBy(*PER).orderBy(F.desc(similarity))
    return sets.withColumn("r", F.rank().over(w)).filter("r = 1").drop("r").withColumn("set_key", F.lit("nearest"))


def context_gap_sets(best: DataFrame, similarity: str, gap: float = 0.01) -> DataFrame:
    """key, parser, set_key of the set with the best similarity, if the next different set is at least the gap below.

    ``best`` need hold no more than the most similar rows of each set.
    """
    per = best.groupBy(*PER, "set_key").agg(F.max(similarity).alias("s"))
    w = Window.partitionBy(*PER).orderBy(F.desc("s"), "set_key")
    top = per.withColumn("next", F.lead("s").over(w)).withColumn("r", F.row_number().over(w)).filter("r = 1 and (next is null or s - next >= " + repr(gap) + ")")
    return top.select(*PER, "set_key")


def by_context_gap(sets: DataFrame, similarity: str, gap: float = 0.01) -> DataFrame:
    """The set with the best context similarity, if the next different set is at least the gap below."""
    return sets.join(context_gap_sets(sets, similarity, gap), [*PER, "set_key"], "left_semi")


def by_best_synonym(synonyms: DataFrame, similarity: str, least: float = 0.7) -> DataFrame:
    """key, parser, set_key of the best-scored synonym above the limit that points at exactly one set.

    ``synonyms``: key, parser, syn_norm, set_key, similarity.
    """
    ok = synonyms.filter(F.col(similarity) >= least)
    per = ok.groupBy(*PER, "syn_norm").agg(F.max(similarity).alias("s"), F.countDistinct("set_key").alias("n"), F.min("set_key").alias("set_key")).filter("n = 1")
    w = Window.partitionBy(*PER).orderBy(F.desc("s"), "syn_norm")
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*PER, "set_key")


def single(sets: DataFrame) -> DataFrame:
    """Sets of those keys that have exactly one."""
    one = sets.groupBy(*PER).agg(F.countDistinct("set_key").alias("n")).filter("n = 1").select(*PER)
    return sets.join(one, PER, "left_semi")
