"""Cleanup filters and overlap resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast
from .ner import SECTION

PROBABLE = 50


def drop_where(table: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which no predicate holds; a null predicate doesn't."""
    bad = F.lit(False)
    for p in predicates:
        bad = bad | F.coalesce(p, F.lit(False))
    return table.filter(~bad)


def low_confidence(string_match: Sequence[str] = (), disambiguation: Sequence[str] = ("AMBIGUOUS",)) -> Column:
    """Mappings with one of these confidences; a missing confidence is no reason."""
    return F.col("string_match_confidence").isin(*string_match) | F.col("disambiguation_confidence").isin(*disambiguation)


def drop_unmapped(mentions: DataFrame, mappings: DataFrame, namespaces: Sequence[str] | None = None, below: int | None = PROBABLE) -> DataFrame:
    """Drop mentions of these namespaces without mapping whose confidence is below the level (None: any)."""
    known = mappings.select("ent_id").distinct().withColumn("known", F.lit(True))
    lost = F.lit(True)
    if namespaces is not None:
        lost = lost & F.col("namespace").isin(*namespaces)
    if below is not None:
        lost = lost & (F.col("confidence") < below)
    return mentions.join(known, "ent_id", "left").filter(F.col("known") | ~F.coalesce(lost, F.lit(False))).drop("known")


def other_class(classes: Sequence[str]) -> Column:
    return ~F.col("entity_class").isin(*classes)


def drop_listed(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """Drop mentions whose lower-cased match is listed for their class (entity_class, word)."""
    return (
        mentions.withColumn("word", F.lower("match"))
        .join(maybe_broadcast(words.select("entity_class", "word").distinct()), ["entity_class", "word"], "left_anti")
        .drop("word")
    )


def shorter_than(n: int) -> Column:
    return F.length("match") < n


def keep_best_parser(mappings: DataFrame, ranks: DataFrame) -> DataFrame:
    """Of each mention's mappings those of its best-ranked parser; unranked parsers come last.

    ``ranks``: entity_class, parser, rank (lower is better).
    """
    r = F.coalesce("rank", F.lit(1 << 30))
    placed = mappings.join(maybe_broadcast(ranks), ["entity_class", "parser"], "left").withColumn("rank", r)
    return placed.withColumn("best", F.min("rank").over(Window.partitionBy("ent_id"))).filter("rank = best").drop("rank", "best")


def islands(mentions: DataFrame) -> DataFrame:
    """Mentions with ``island``: overlapping spans share it, touching spans don't."""
    w = Window.partitionBy(*SECTION).orderBy("start", "end", "entity_class", "ent_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return mentions.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("new").over(w)
    ).drop("new")


def merge_overlaps(mentions: DataFrame, class_order: Sequence[str] = (), split_spans: bool = True) -> DataFrame:
    """One mention per island: mapped before unmapped, then the longest, the class listed first, the most
    confident, the greater class name; ``ent_id`` breaks ties.

    ``mentions`` needs is_mapped and ent_id. Mentions of several spans (spans > 1) pass by if ``split_spans``.
    """
    rank = F.lit(0)
    for k, cls in enumerate(class_order):
        rank = F.when(F.col("entity_class") == cls, len(class_order) - 1 - k).otherwise(rank)
    whole = mentions.filter(F.coalesce(F.col("spans"), F.lit(1)) == 1) if split_spans and "spans" in mentions.columns else mentions
    w = Window.partitionBy(*SECTION, "island").orderBy(
        F.desc("is_mapped"), F.desc(F.col("end") - F.col("start")), F.desc("class_rank"), F.desc("confidence"), F.desc("entity_class"), "ent_id"
    )
    won = islands(whole).withColumn("class_rank", rank).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "class_rank", "island")
    if whole is mentions:
        return won
    return won.unionByName(mentions.filter(F.col("spans") > 1))
