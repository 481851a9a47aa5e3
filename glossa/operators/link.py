"""Linking of mention strings to candidates: exact, then TF-IDF top-k over character pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams
from .common import maybe_broadcast

Grams = Callable[[Column], Column]


def gram_index(keys: DataFrame, key: str = "syn_norm", grams: Grams = char_ngrams, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(idf: gram, idf; postings: key, gram, weight): smooth idf ln((1 + n) / (1 + df)) + 1, unit vectors.

    With ``by`` every combination of those columns is an index of its own, with its own idf.
    """
    docs = keys.select(*by, key).distinct()
    tf = docs.select(*by, key, F.explode(grams(F.col(key))).alias("gram")).groupBy(*by, key, "gram").agg(F.count("*").alias("tf"))
    n = docs.groupBy(*by).agg(F.count("*").alias("n_keys"))
    df = tf.groupBy(*by, "gram").agg(F.count("*").alias("df"))
    # Without ``by`` n is one row.
    sized = df.join(maybe_broadcast(n), list(by)) if by else df.crossJoin(F.broadcast(n))
    idf = sized.select(*by, "gram", (F.log((1 + F.col("n_keys")) / (1 + F.col("df"))) + 1).alias("idf"))
    return idf, _unit(tf.join(idf, [*by, "gram"]), key, by)


def _unit(weighted: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    raw = weighted.withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(*by, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, [*by, key]).select(*by, key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def query_vectors(queries: DataFrame, idf: DataFrame, key: str = "query", grams: Grams = char_ngrams, by: Sequence[str] = ()) -> DataFrame:
    """Unit vectors of distinct queries over the grams of the index; grams it doesn't know have no weight."""
    tf = queries.select(*by, key).distinct().select(*by, key, F.explode(grams(F.col(key))).alias("gram")).groupBy(*by, key, "gram").agg(F.count("*").alias("tf"))
    return _unit(tf.join(maybe_broadcast(idf), [*by, "gram"]), key, by)


def top_candidates(queries: DataFrame, keys: DataFrame, k: int = 20, query: str = "query", key: str = "syn_norm", by: Sequence[str] = ()) -> DataFrame:
    """query, syn_norm, score (100 * cosine), rank: the k best candidates of each distinct query above zero.

    With ``by`` (columns of both sides) queries meet only the keys of their own combination.
    """
    idf, postings = gram_index(keys, key, by=by)
    q = query_vectors(queries, idf, query, by=by).withColumnRenamed("weight", "q_weight")
    scored = q.join(postings, [*by, "gram"]).groupBy(*by, query, key).agg((100 * F.sum(F.col("q_weight") * F.col("weight"))).alias("score"))
    w = Window.partitionBy(*by, query).orderBy(F.desc(F.round("score", 6)), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("score") > 0))


def link(
    mentions: DataFrame, cands: DataFrame, k: int = 20, accept: Callable[[Column, Column], Column] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """match_norm, syn_norm, exact_match, search_score for each distinct normal form of ``mentions``.

    A normal form that is a candidate's links to it alone; only the others are searched. ``accept`` may
    then refuse pairs (so fewer than k remain). With ``by`` all of this holds in each combination apart.
    """
    queries = mentions.select(*by, "match_norm").distinct()
    keys = cands.select(*by, "syn_norm").distinct()
    exact = queries.join(maybe_broadcast(keys.withColumn("match_norm", F.col("syn_norm"))), [*by, "match_norm"]).select(
        *by, "match_norm", "syn_norm", F.lit(True).alias("exact_match"), F.lit(None).cast("double").alias("search_score")
    )
    rest = queries.join(exact.select(*by, "match_norm"), [*by, "match_norm"], "left_anti")
    near = top_candidates(rest.select(*by, F.col("match_norm").alias("query")), keys, k, by=by).select(
        *by, F.col("query").alias("match_norm"), "syn_norm", F.lit(False).alias("exact_match"), F.col("score").alias("search_score")
    )
    if accept is not None:
        near = near.filter(accept(F.col("match_norm"), F.col("syn_norm")))
    return exact.unionByName(near)


def link_by_class(mentions: DataFrame, cands: DataFrame, k: int = 20, accept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """entity_class, match_norm, parser, syn_norm, exact_match, search_score for mentions (entity_class, match_norm).

    A mention is sought in every vocabulary (``cands``: parser, entity_class, syn_norm) of its class and in
    no other; each vocabulary has its own index, and an exact hit in one doesn't end the search of others.
    """
    served = cands.select("parser", "entity_class").distinct()
    asked = mentions.select("entity_class", "match_norm").distinct().join(maybe_broadcast(served), "entity_class")
    return link(asked, cands, k, accept, ["parser", "entity_class"])


def text_similarity(pairs: DataFrame, left: str, right: str, grams: Grams) -> DataFrame:
    """Pairs with the cosine of their TF-IDF vectors, idf from all distinct right strings."""
    idf, postings = gram_index(pairs.select(right), right, grams)
    q = query_vectors(pairs.select(left), idf, left, grams).withColumnRenamed("weight", "q_weight")
    dots = (
        pairs.select(left, right).distinct().join(q, left).join(postings, [right, "gram"])
        .groupBy(left, right).agg(F.sum(F.col("q_weight") * F.col("weight")).alias("cosine"))
    )
    return pairs.join(dots, [left, right], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def expand_xrefs(mappings: DataFrame, xrefs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Mappings of the identifiers that cross references lead to, where the target is known.

    ``xrefs``: source, idx, target_source, target_idx; ``metadata``: source, idx, default_label.
    """
    hops = mappings.join(xrefs, ["source", "idx"]).drop("default_label")
    known = metadata.select(F.col("source").alias("target_source"), F.col("idx").alias("target_idx"), "default_label")
    moved = hops.join(known, ["target_source", "target_idx"])
    return moved.withColumn("xref_source", F.col("source")).withColumn("source", F.col("target_source")).withColumn(
        "idx", F.col("target_idx")
    ).drop("target_source", "target_idx")
