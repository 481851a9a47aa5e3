"""Vocabularies: candidates, id grouping, conflicts, curation and upgrade reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize_by, symbolic_by
from .common import maybe_broadcast

IGNORE, POSSIBLE, PROBABLE, HIGHLY_LIKELY = 0, 10, 50, 100
NER, LINKING, DROP = "ADD_FOR_NER_AND_LINKING", "ADD_FOR_LINKING_ONLY", "DROP_FOR_LINKING"


def with_norms(kb: DataFrame) -> DataFrame:
    """The long table with syn_norm and symbolic, normalising each distinct (string, class) once."""
    strings = kb.select("syn", "entity_class").distinct()
    norms = strings.withColumn("syn_norm", normalize_by(F.col("syn"), F.col("entity_class"))).withColumn(
        "symbolic", symbolic_by(F.col("syn"), F.col("entity_class"))
    )
    return kb.join(norms, ["syn", "entity_class"])


def fill_labels(kb: DataFrame) -> DataFrame:
    """A missing default label is the identifier; rows without identifier or synonym go."""
    return kb.withColumn("default_label", F.coalesce("default_label", "idx")).filter("idx is not null and syn is not null")


def metadata(kb: DataFrame) -> DataFrame:
    """One row per (parser, idx): the least of its default labels, and every further column of that row."""
    rest = [c for c in kb.columns if c not in ("parser", "idx", "syn", "mapping_type", "default_label")]
    first = F.min(F.struct("default_label", *rest)).alias("m")
    return kb.groupBy("parser", "idx").agg(first).select("parser", "idx", "m.*")


def candidates(kb: DataFrame) -> DataFrame:
    """parser, syn_norm, is_symbolic (all strings are), raw_synonyms, ids, mapping_types: one row per normal form."""
    return (
        with_norms(kb)
        .groupBy("parser", "entity_class", "syn_norm")
        .agg(
            F.bool_and("symbolic").alias("is_symbolic"),
            F.array_sort(F.collect_set("syn")).alias("raw_synonyms"),
            F.array_sort(F.collect_set("idx")).alias("ids"),
            F.array_sort(F.collect_set("mapping_type")).alias("mapping_types"),
        )
    )


def set_key(ids: Column) -> Column:
    """A key under which equal sets of ids are equal."""
    return F.xxhash64(F.array_sort(F.array_distinct(ids)))


def group_simple(cands: DataFrame, scored: bool = True) -> DataFrame:
    """Candidates with id_sets and aggregated_by where no similarity is needed; others have null in both.

    Without a scorer each id is a set (NO_STRATEGY); one id is UNAMBIGUOUS; the ids of a noun phrase are
    one set (MERGED_AS_NON_SYMBOLIC).
    """
    each = F.transform("ids", lambda i: F.array(i))
    if not scored:
        return cands.withColumn("id_sets", each).withColumn("aggregated_by", F.lit("NO_STRATEGY"))
    one = F.size("ids") == 1
    return cands.withColumn("id_sets", F.when(one | ~F.col("is_symbolic"), F.array("ids"))).withColumn(
        "aggregated_by", F.when(one, "UNAMBIGUOUS").when(~F.col("is_symbolic"), "MERGED_AS_NON_SYMBOLIC")
    )


def group_by_label(kb: DataFrame) -> DataFrame:
    """parser, syn_norm, default_label, ids: the ids of a normal form that share a label are one set (CUSTOM)."""
    return with_norms(kb).groupBy("parser", "syn_norm", "default_label").agg(F.array_sort(F.collect_set("idx")).alias("ids"))


def group_singletons(cands: DataFrame) -> DataFrame:
    """parser, syn_norm, idx: every id is a set of its own (CUSTOM)."""
    return cands.select("parser", "syn_norm", F.explode("ids").alias("idx"))


def group_by_xref(ids: DataFrame, xrefs: DataFrame) -> DataFrame:
    """key, shared, ids: ids of a key whose cross references meet in the same set are one group.

    ``ids``: key, idx; ``xrefs``: idx, xref. Pairs come from joining on the references that they share, so
    ids without a common one never meet. Keys where an id falls into several groups are left out, for the
    caller's other way; ids in no group stay single.
    """
    refs = ids.join(xrefs, "idx").distinct()
    pairs = (
        refs.alias("a")
        .join(refs.alias("b"), ["key", "xref"])
        .filter("a.idx < b.idx")
        .groupBy("key", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"))
        .agg(F.array_join(F.array_sort(F.collect_set("xref")), "|").alias("shared"))
    )
    groups = (
        pairs.withColumn("idx", F.explode(F.array("i", "j")))
        .groupBy("key", "shared")
        .agg(F.array_sort(F.collect_set("idx")).alias("ids"))
    )
    twice = groups.select("key", F.explode("ids").alias("idx")).groupBy("key", "idx").count().filter("count > 1").select("key").distinct()
    clear = groups.join(twice, "key", "left_anti")
    left = ids.select("key", "idx").distinct().join(clear.select("key", F.explode("ids").alias("idx")), ["key", "idx"], "left_anti").join(twice, "key", "left_anti")
    return clear.unionByName(left.select("key", F.lit("").alias("shared"), F.array("idx").alias("ids")))


def group_by_similarity(cands: DataFrame, labels: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Candidates with id_sets by greedy attachment, ids in ascending order.

    An id joins the set with the most similar label (edit similarity above the threshold), or begins a
    new one. ``labels``: parser, idx, default_label. Ids of one label always share a set (below a threshold
    of 1), so only the distinct labels of a normal form are compared, each pair once.
    """
    same = ["label"] if threshold < 1 else ["idx", "label"]
    named = (
        cands.select("parser", "syn_norm", F.explode("ids").alias("idx"))
        .join(labels.select("parser", "idx", "default_label"), ["parser", "idx"], "left")
        .withColumn("label", F.coalesce("default_label", "idx"))
        .groupBy("parser", "syn_norm", *same)
        .agg(F.collect_set("idx").alias("ids"), F.min("idx").alias("first"))
        .groupBy("parser", "syn_norm")
        .agg(F.array_sort(F.collect_list(F.struct("first", "label", "ids"))).alias("named"))
    )
    sim = "1 - levenshtein(y.label, x.label) / greatest(length(y.label), length(x.label), 1)"
    # The best of the labels so far, and of equals the one whose set is oldest.
    best = f"array_max(transform(placed, y -> struct({sim} as sim, -y.no as no)))"
    step = f"""aggregate(named, cast(array() as array<struct<label:string,no:int>>), (placed, x) -> array_append(placed, struct(x.label as label,
        transform(array({best}), b -> if(b.sim > {threshold}, -b.no, coalesce(array_max(placed.no), -1) + 1))[0] as no)))"""
    sets = F.expr("""transform(sequence(0, array_max(placed.no)), s -> array_sort(flatten(
        transform(filter(named, (x, i) -> placed[i].no = s), x -> x.ids))))""")
    return named.withColumn("placed", F.expr(step)).withColumn("id_sets", sets).drop("named", "placed")


def default_resources(cands: DataFrame) -> DataFrame:
    """resource_key, text, case_sensitive, confidence, behaviour: every raw synonym, open to NER and linking."""
    return cands.select(
        "parser",
        F.col("syn_norm").alias("resource_key"),
        F.explode("raw_synonyms").alias("text"),
        F.lit(False).alias("case_sensitive"),
        F.lit(PROBABLE).alias("confidence"),
        F.lit(NER).alias("behaviour"),
    )


def norm_conflicts(resources: DataFrame) -> DataFrame:
    """syn_norm, n_resources, n_behaviours, conflict: normal forms that several resources claim.

    They conflict if their behaviours or overriding ids differ; otherwise they can be merged.
    ``resources``: resource_id, syn_norm, behaviour, override (string or null).
    """
    return (
        resources.groupBy("syn_norm")
        .agg(
            F.countDistinct("resource_id").alias("n_resources"),
            F.countDistinct("behaviour").alias("n_behaviours"),
            F.countDistinct(F.coalesce("override", F.lit(""))).alias("n_overrides"),
        )
        .filter("n_resources > 1")
        .withColumn("conflict", F.expr("n_behaviours > 1 or n_overrides > 1"))
        .drop("n_overrides")
    )


def case_conflicts(strings: DataFrame, strict: bool = False) -> DataFrame:
    """low: lower-cased strings whose settings contradict each other.

    Either a case-insensitive string has several confidences, or a case-sensitive one isn't more
    confident than the case-insensitive one (or, if strict, exists beside it at all).
    """
    ci, cs = "not case_sensitive", "case_sensitive"
    g = strings.groupBy(F.lower("text").alias("low")).agg(
        F.expr(f"count(distinct confidence) filter (where {ci})").alias("n_ci"),
        F.expr(f"max(confidence) filter (where {ci})").alias("ci"),
        F.expr(f"min(confidence) filter (where {cs})").alias("cs"),
    )
    beside = F.col("ci").isNotNull() & F.col("cs").isNotNull()
    return g.filter((F.col("n_ci") > 1) | (beside & (F.lit(strict) | (F.col("cs") <= F.col("ci"))))).select("low")


def clean_resources(strings: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Strings of the resources that no conflict touches, directly or by another string of theirs."""
    bad = strings.join(conflicts, F.lower(strings["text"]) == conflicts["low"]).select("resource_id").distinct()
    return strings.join(bad, "resource_id", "left_anti")


def autofix(strings: DataFrame, optimistic: bool = True) -> DataFrame:
    """One setting per (syn_norm, lower-cased text): the most or the least permissive of all, and the
    strongest behaviour of the normal form (drop, then linking only, then NER)."""
    order = F.when(F.col("behaviour") == DROP, 2).when(F.col("behaviour") == LINKING, 1).otherwise(0)
    per = strings.withColumn("strength", order)
    behaviour = per.groupBy("syn_norm").agg(F.max("strength").alias("strength"))
    cs, conf = (F.bool_and, F.max) if optimistic else (F.bool_or, F.min)
    fixed = per.groupBy("syn_norm", F.lower("text").alias("low")).agg(
        cs("case_sensitive").alias("case_sensitive"), conf("confidence").alias("confidence"), F.count("*").alias("n")
    )
    name = F.when(F.col("strength") == 2, DROP).when(F.col("strength") == 1, LINKING).otherwise(NER)
    return fixed.join(behaviour, "syn_norm").withColumn("behaviour", name).drop("strength")


def merge_curation(human: DataFrame, auto: DataFrame) -> DataFrame:
    """syn_norm, behaviour, origin: human decisions over automatic ones.

    Human-only resources are obsolete unless ``additional`` is set on them. Both have syn_norm, behaviour.
    """
    h = human.select("syn_norm", F.col("behaviour").alias("h"), "additional")
    a = auto.select("syn_norm", F.col("behaviour").alias("a"))
    both = h.join(a, "syn_norm", "full_outer")
    origin = (
        F.when(F.col("h").isNotNull() & F.col("a").isNotNull(), "human")
        .when(F.col("h").isNull(), "auto")
        .when(F.coalesce("additional", F.lit(False)), "human_additional")
        .otherwise("obsolete")
    )
    return both.select("syn_norm", F.coalesce("h", "a").alias("behaviour"), origin.alias("origin"))


def drop_ids(cands: DataFrame, dropped: DataFrame) -> DataFrame:
    """Candidates without the ids of ``dropped`` (parser, idx); those left without any go; changed ones are marked."""
    ids = cands.select("parser", "syn_norm", F.explode("ids").alias("idx"))
    left = (
        ids.join(maybe_broadcast(dropped.select("parser", "idx").distinct()), ["parser", "idx"], "left_anti")
        .groupBy("parser", "syn_norm")
        .agg(F.array_sort(F.collect_set("idx")).alias("left"))
    )
    changed = F.size("left") < F.size("ids")
    out = cands.join(left, ["parser", "syn_norm"]).withColumn("modified", changed).withColumn("ids", F.col("left"))
    return out.drop("left")


def apply_overrides(cands: DataFrame, overrides: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with the id sets that curation gives (parser, syn_norm, idx), ids unknown to the parser left out."""
    valid = (
        overrides.join(known.select("parser", "idx").distinct(), ["parser", "idx"])
        .groupBy("parser", "syn_norm")
        .agg(F.array_sort(F.collect_set("idx")).alias("given"))
    )
    out = cands.join(valid, ["parser", "syn_norm"], "left")
    marked = F.when(F.col("given").isNotNull(), "MODIFIED_BY_CURATION").otherwise("UNCHANGED")
    return out.withColumn("aggregated_by", marked).withColumn("ids", F.coalesce("given", "ids")).drop("given")


def upgrade(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are new, rows that are gone) between two versions of a table."""
    return new.subtract(old), old.subtract(new)


def discrepancies(human: DataFrame, auto: DataFrame, on: tuple[str, ...] = ("kind", "text")) -> DataFrame:
    """Strings that only one side has, with the side."""
    h, a = human.select(*on).distinct().withColumn("in_human", F.lit(1)), auto.select(*on).distinct().withColumn("in_auto", F.lit(1))
    both = h.join(a, list(on), "full_outer")
    return both.filter("in_human is null or in_auto is null").select(*on, F.when(F.col("in_human").isNull(), "auto").otherwise("human").alias("side"))


def dedupe_largest(docs: DataFrame, key: str, size: Column) -> DataFrame:
    """One row per key, that of greatest size (ties: the least of all other columns)."""
    rest = [c for c in docs.columns if c != key]
    w = Window.partitionBy(key).orderBy(size.desc(), *rest)
    return docs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
