"""Vocabulary building: long table, candidates, id grouping, conflicts, curation, synonyms, automatic rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import synonyms as S
from . import duck
from .fixtures import STRINGS, catalogue, strings, table

JOIN = lambda c: F.array_join(c, "|")


def kb_long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fill_labels(catalogue(spark, sf_dir)).select("parser", "idx", "default_label", "syn", "mapping_type")


def kb_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.metadata(catalogue(spark, sf_dir)).select("idx", "default_label", "source", "annotation_score")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.candidates(catalogue(spark, sf_dir))


#: CTEs ending in cands(norm, is_symbolic, raw, ids, kinds) over the parts.
_CANDS = f"""WITH {duck.normalized("SELECT DISTINCT p_name AS s FROM part")}, cands AS (
  SELECT norm, bool_and(symbolic) AS is_symbolic, list_sort(list(DISTINCT p_name)) AS raw,
    list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))) AS ids, list_sort(list(DISTINCT p_type)) AS kinds
  FROM part JOIN normed ON p_name = s GROUP BY norm)
"""
_J = "array_to_string({}, '|')"


def kb_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("syn_norm", "is_symbolic", JOIN("raw_synonyms").alias("raw"), JOIN("ids").alias("ids"), JOIN("mapping_types").alias("kinds"))


def kb_default_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.default_resources(_candidates(spark, sf_dir)).select("resource_key", "text", "case_sensitive", "confidence", "behaviour")


def id_group_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_singletons(_candidates(spark, sf_dir)).select("syn_norm", "idx")


def id_group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_by_label(catalogue(spark, sf_dir)).select("syn_norm", "default_label", JOIN("ids").alias("ids"))


def id_group_non_symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.group_simple(_candidates(spark, sf_dir))
    return g.select("syn_norm", F.coalesce("aggregated_by", F.lit("")).alias("aggregated_by"), F.coalesce(F.array_join(F.transform("id_sets", JOIN), ";"), F.lit("")).alias("sets"))


def id_group_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand whose suppliers in the line items meet in the same set."""
    ids = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type", "p_name", F.col("p_size").cast("string")).alias("key"), F.col("p_partkey").alias("idx"))
    xrefs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("idx"), F.col("l_suppkey").cast("string").alias("xref")).distinct()
    return C.group_by_xref(ids, xrefs).select("key", "shared", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"))


_XREF_SQL = """
WITH ids AS (SELECT concat_ws(' ', p_brand, p_type, p_name, p_size) AS key, p_partkey AS idx FROM part),
x AS (SELECT DISTINCT l_partkey AS idx, CAST(l_suppkey AS VARCHAR) AS xref FROM lineitem),
r AS (SELECT DISTINCT key, idx, xref FROM ids JOIN x USING (idx)),
pairs AS (SELECT a.key, a.idx AS i, b.idx AS j, array_to_string(list_sort(list(DISTINCT a.xref)), '|') AS shared
  FROM r a JOIN r b ON a.key = b.key AND a.xref = b.xref AND a.idx < b.idx GROUP BY ALL),
m AS (SELECT key, shared, i AS idx FROM pairs UNION SELECT key, shared, j FROM pairs),
twice AS (SELECT DISTINCT key FROM (SELECT key, idx FROM m GROUP BY ALL HAVING count(*) > 1)),
clear AS (SELECT key, shared, list_sort(list(idx)) AS ids FROM m WHERE key NOT IN (SELECT key FROM twice) GROUP BY ALL)
SELECT key, shared, array_to_string(ids, '|') AS ids FROM clear
UNION ALL
SELECT DISTINCT key, '', CAST(idx AS VARCHAR) FROM ids WHERE key NOT IN (SELECT key FROM twice) AND (key, idx) NOT IN (SELECT key, unnest(ids) FROM clear)
"""


def id_group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalogue(spark, sf_dir)
    labels = cat.select("parser", "idx", F.concat_ws(" ", "default_label", "source").alias("default_label"))
    small = C.candidates(cat.withColumn("syn", F.concat_ws(" ", "source", "mapping_type")))
    g = C.group_by_similarity(small, labels, 0.9)
    return g.select("syn_norm", F.size("id_sets").alias("n_sets"), F.array_join(F.transform("id_sets", JOIN), ";").alias("sets"))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource per part: its name as string, behaviour by size, ids overridden for some."""
    p = table(spark, sf_dir, "part")
    behaviour = F.when(F.col("p_size") % 10 == 0, C.DROP).when(F.col("p_size") % 10 == 1, C.LINKING).otherwise(C.NER)
    return p.select(
        F.col("p_partkey").alias("resource_id"), F.upper("p_name").alias("syn_norm"), F.col("p_name").alias("text"), behaviour.alias("behaviour"),
        F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).alias("override"), (F.col("p_size") % 3 == 0).alias("case_sensitive"),
        F.when(F.col("p_size") % 4 == 0, 100).when(F.col("p_size") % 4 == 1, 10).otherwise(50).alias("confidence"), "p_type",
    )


_RES = """WITH res AS (SELECT p_partkey AS resource_id, upper(p_name) AS syn_norm, p_name AS text, p_type,
  CASE WHEN p_size % 10 = 0 THEN 'DROP_FOR_LINKING' WHEN p_size % 10 = 1 THEN 'ADD_FOR_LINKING_ONLY' ELSE 'ADD_FOR_NER_AND_LINKING' END AS behaviour,
  CASE WHEN p_size % 7 = 0 THEN p_brand END AS override, p_size % 3 = 0 AS case_sensitive,
  CASE p_size % 4 WHEN 0 THEN 100 WHEN 1 THEN 10 ELSE 50 END AS confidence FROM part)
"""


def norm_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resources(spark, sf_dir).withColumn("syn_norm", F.concat_ws(" ", "syn_norm", "p_type"))
    return C.norm_conflicts(r)


def _cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", "override", "p_type"))


def case_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_conflicts(_cased(spark, sf_dir))


_CASED = _RES + ", cased AS (SELECT * REPLACE (concat_ws(' ', text, override, p_type) AS text) FROM res)"
_CASE_CONFLICTS = _CASED + """, g AS (SELECT lower(text) AS low, count(DISTINCT confidence) FILTER (NOT case_sensitive) AS n_ci,
  max(confidence) FILTER (NOT case_sensitive) AS ci, min(confidence) FILTER (case_sensitive) AS cs FROM cased GROUP BY ALL),
bad AS (SELECT low FROM g WHERE n_ci > 1 OR cs <= ci)"""


def clean_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _cased(spark, sf_dir)
    return C.clean_resources(r, C.case_conflicts(r)).select("resource_id", "text")


def _autofix(optimistic: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.autofix(_resources(spark, sf_dir), optimistic).select("syn_norm", "low", "case_sensitive", "confidence", "behaviour", "n")

    cs, conf = ("bool_and", "max") if optimistic else ("bool_or", "min")
    sql = _RES + f"""SELECT syn_norm, lower(text) AS low, {cs}(case_sensitive) AS case_sensitive, {conf}(confidence) AS confidence, count(*) AS n,
      CASE WHEN bool_or(bool_or(behaviour = 'DROP_FOR_LINKING')) OVER w THEN 'DROP_FOR_LINKING'
        WHEN bool_or(bool_or(behaviour = 'ADD_FOR_LINKING_ONLY')) OVER w THEN 'ADD_FOR_LINKING_ONLY' ELSE 'ADD_FOR_NER_AND_LINKING' END AS behaviour
      FROM res GROUP BY syn_norm, lower(text) WINDOW w AS (PARTITION BY syn_norm)"""
    return query, sql


def merge_human_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as human decisions over customers as automatic ones, by the number in their names."""
    human = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("syn_norm"), F.when(F.col("s_acctbal") > 0, C.NER).otherwise(C.DROP).alias("behaviour"), (F.col("s_nationkey") % 2 == 0).alias("additional")
    )
    auto = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("syn_norm"), F.lit(C.NER).alias("behaviour"))
    return C.merge_curation(human, auto)


_MERGE_SQL = """
WITH h AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN 'ADD_FOR_NER_AND_LINKING' ELSE 'DROP_FOR_LINKING' END AS b, s_nationkey % 2 = 0 AS more FROM supplier),
a AS (SELECT c_custkey AS k, 'ADD_FOR_NER_AND_LINKING' AS b FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(h.k, a.k) AS syn_norm, coalesce(h.b, a.b) AS behaviour,
  CASE WHEN h.k IS NOT NULL AND a.k IS NOT NULL THEN 'human' WHEN h.k IS NULL THEN 'auto' WHEN more THEN 'human_additional' ELSE 'obsolete' END AS origin
FROM h FULL JOIN a ON h.k = a.k
"""


def drop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "part").filter("p_size < 25").select(F.lit("parts").alias("parser"), F.col("p_partkey").cast("string").alias("idx"))
    return C.drop_ids(_candidates(spark, sf_dir), gone).select("syn_norm", JOIN("ids").alias("ids"), "modified")


def apply_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = _candidates(spark, sf_dir)
    given = table(spark, sf_dir, "supplier").select(F.lit("parts").alias("parser"), F.col("s_suppkey").cast("string").alias("idx"))
    first = cands.filter(F.length("syn_norm") % 2 == 0).select("syn_norm")
    overrides = given.join(F.broadcast(first))
    return C.apply_overrides(cands, overrides, catalogue(spark, sf_dir)).select("syn_norm", JOIN("ids").alias("ids"), "aggregated_by")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_size")
    row = ["p_name", "p_brand", "p_type"]
    return p.filter("p_size <= 30").select(*row), p.filter("p_size >= 20").select(*row)


def upgrade_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upgrade(*_versions(spark, sf_dir))[0]


def upgrade_obsolete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upgrade(*_versions(spark, sf_dir))[1]


def curation_superfluous(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return old.intersect(new)


def discrepancy_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.lit("s").alias("kind"), F.col("s_nationkey").cast("string").alias("text"))
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9800").select(F.lit("s").alias("kind"), F.col("c_nationkey").cast("string").alias("text"))
    return C.discrepancies(h, a)


def _generated(gen):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strings(spark, sf_dir).select("s", F.explode(gen(F.col("s"))).alias("variant")).distinct()

    return query


_SUFFIXES = ("s", "es", "in", "et")
_TOKENS = [("small", "big", "cold"), ("widget", "gadget")]
_VARIANTS = [("widget", "wijjet"), ("colour", "color"), ("cold", "colde"), ("x", "ex")]


def syn_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = strings(spark, sf_dir).select(F.explode(F.split("s", " ")).alias("text")).distinct()
    return S.spelling_variants(words, spark.createDataFrame(_VARIANTS, "word string, variant string"))


def _variants_sql(expr: str) -> str:
    return f"WITH src AS ({STRINGS}), v AS (SELECT s, unnest({expr}) AS variant FROM src) SELECT DISTINCT s, variant FROM v WHERE variant IS NOT NULL AND variant <> s AND variant <> ''"


_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_STOP_SQL = f"""WITH src AS ({STRINGS}), k AS (SELECT s, list_filter(string_split(s, ' '), lambda w: lower(w) NOT IN ({_STOPS})) AS kept FROM src)
SELECT DISTINCT s, array_to_string(kept, ' ') AS variant FROM k WHERE len(kept) < len(string_split(s, ' '))"""
_HYPHEN_SQL = f"""WITH src AS ({STRINGS}), d AS (SELECT unnest([{", ".join(duck.quote(d) for d in S.DASHES)}]) AS dash)
SELECT DISTINCT s, string_split(s, ' ')[1] || dash || string_split(s, ' ')[2] AS variant FROM src, d WHERE len(string_split(s, ' ')) = 2"""
_SUFFIX_SQL = _variants_sql("[" + ", ".join(f"CASE WHEN ends_with(s, '{a}') THEN left(s, length(s) - {len(a)}) || '{b}' END" for a in _SUFFIXES for b in _SUFFIXES if a != b) + "]")
_REPLACE_SQL = _variants_sql("[trim(replace(s, '-', ' ')), trim(replace(s, '-', '_')), trim(replace(s, ' NOS', '')), " + duck.rx("s", r" (\d)", r"-\1") + "]")
_TOKEN_SQL = f"""WITH src AS ({STRINGS}), t AS (SELECT * FROM (VALUES {", ".join(f"({g}, '{w}')" for g, ws in enumerate(_TOKENS) for w in ws)}) AS t(g, w)),
p AS (SELECT s, string_split(s, ' ') AS ws, unnest(range(1, len(string_split(s, ' ')) + 1)) AS i FROM src),
h AS (SELECT s, ws, i, b.w AS new FROM p JOIN t a ON lower(ws[i]) = a.w JOIN t b ON a.g = b.g)
SELECT DISTINCT s, array_to_string(list_transform(ws, lambda w, k: CASE WHEN k = i THEN new ELSE w END), ' ') AS variant FROM h
WHERE array_to_string(list_transform(ws, lambda w, k: CASE WHEN k = i THEN new ELSE w END), ' ') <> s"""
_SPELL_SQL = f"""WITH src AS ({STRINGS}), w AS (SELECT DISTINCT unnest(string_split(s, ' ')) AS text FROM src)
SELECT DISTINCT text, variant FROM w JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _VARIANTS)}) AS v(word, variant) ON lower(text) = word"""


def syn_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of three generators over the part names."""
    r = table(spark, sf_dir, "part").select(F.upper("p_name").alias("resource_key"), F.col("p_name").alias("text")).distinct()
    return S.generate(r, [S.hyphenate, S.swap_tokens(_TOKENS), S.replace_strings({"-": [" ", "_"]})])


def _curated(action):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = strings(spark, sf_dir).select(
            "s", F.array("s").alias("originals"), F.lit(False).alias("case_sensitive"), F.lit(C.PROBABLE).alias("confidence"), F.lit(C.NER).alias("behaviour")
        )
        return S.curate(r, action).select("s", "case_sensitive", "confidence", "behaviour")

    return query


def _curated_sql(cs: str = "false", conf: str = "50", behaviour: str = "'ADD_FOR_NER_AND_LINKING'") -> str:
    return f"WITH src AS ({STRINGS}) SELECT s, {cs} AS case_sensitive, {conf} AS confidence, {behaviour} AS behaviour FROM src"


_COMMON = ("cold", "small", "left", "phase", "cell", "widget", "lung", "x")
_COMMON_SQL = f"CASE WHEN len(list_filter(string_split(lower(s), ' '), lambda w: w NOT IN ({', '.join(map(repr, _COMMON))}))) = 0 THEN 10 ELSE 50 END"

CATALOGUE = {
    "kb_long_table": (kb_long_table, "SELECT 'parts' AS parser, CAST(p_partkey AS VARCHAR) AS idx, p_name AS default_label, p_name AS syn, p_type AS mapping_type FROM part"),
    "kb_metadata": (kb_metadata, "SELECT CAST(p_partkey AS VARCHAR) AS idx, p_name AS default_label, p_brand AS source, p_size AS annotation_score FROM part"),
    "kb_candidates": (kb_candidates, _CANDS + f"SELECT norm AS syn_norm, is_symbolic, {_J.format('raw')} AS raw, {_J.format('ids')} AS ids, {_J.format('kinds')} AS kinds FROM cands"),
    "kb_default_resources": (
        kb_default_resources,
        _CANDS + "SELECT norm AS resource_key, unnest(raw) AS text, false AS case_sensitive, 50 AS confidence, 'ADD_FOR_NER_AND_LINKING' AS behaviour FROM cands",
    ),
    "id_group_singleton": (id_group_singleton, _CANDS + "SELECT norm AS syn_norm, unnest(ids) AS idx FROM cands"),
    "id_group_label": (
        id_group_label,
        _CANDS + f"SELECT norm AS syn_norm, p_name AS default_label, {_J.format('list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR)))')} AS ids FROM part JOIN normed ON p_name = s GROUP BY ALL",
    ),
    "id_group_non_symbolic": (
        id_group_non_symbolic,
        _CANDS + f"""SELECT norm AS syn_norm, CASE WHEN len(ids) = 1 THEN 'UNAMBIGUOUS' WHEN NOT is_symbolic THEN 'MERGED_AS_NON_SYMBOLIC' ELSE '' END AS aggregated_by,
          CASE WHEN len(ids) = 1 OR NOT is_symbolic THEN {_J.format('ids')} ELSE '' END AS sets FROM cands""",
    ),
    "id_group_xref": (id_group_xref, _XREF_SQL),
    "id_group_similarity": (id_group_similarity, None),
    "norm_conflicts": (
        norm_conflicts,
        _RES + """SELECT concat_ws(' ', syn_norm, p_type) AS syn_norm, count(DISTINCT resource_id) AS n_resources, count(DISTINCT behaviour) AS n_behaviours,
          count(DISTINCT behaviour) > 1 OR count(DISTINCT coalesce(override, '')) > 1 AS conflict FROM res GROUP BY ALL HAVING count(DISTINCT resource_id) > 1""",
    ),
    "case_conflicts": (case_conflicts, _CASE_CONFLICTS + " SELECT low FROM bad"),
    "clean_resources": (
        clean_resources,
        _CASE_CONFLICTS + " SELECT resource_id, text FROM cased WHERE resource_id NOT IN (SELECT resource_id FROM cased JOIN bad ON lower(text) = low)",
    ),
    "autofix_optimistic": _autofix(True),
    "autofix_pessimistic": _autofix(False),
    "merge_human_auto": (merge_human_auto, _MERGE_SQL),
    "drop_ids": (
        drop_ids,
        _CANDS + f""", k AS (SELECT norm, ids, list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR)) FILTER (p_size >= 25)) AS rest
          FROM cands JOIN (SELECT *, CAST(p_partkey AS VARCHAR) AS id FROM part) ON list_contains(ids, id) GROUP BY ALL)
        SELECT norm AS syn_norm, {_J.format('rest')} AS ids, len(rest) < len(ids) AS modified FROM k WHERE len(rest) > 0""",
    ),
    "apply_override": (
        apply_override,
        _CANDS + f""", g AS (SELECT list_sort(list(DISTINCT CAST(s_suppkey AS VARCHAR))) AS given FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part))
        SELECT norm AS syn_norm, CASE WHEN length(norm) % 2 = 0 THEN {_J.format('given')} ELSE {_J.format('ids')} END AS ids,
          CASE WHEN length(norm) % 2 = 0 THEN 'MODIFIED_BY_CURATION' ELSE 'UNCHANGED' END AS aggregated_by FROM cands, g""",
    ),
    "upgrade_new": (upgrade_new, "SELECT p_name, p_brand, p_type FROM part WHERE p_size >= 20 EXCEPT SELECT p_name, p_brand, p_type FROM part WHERE p_size <= 30"),
    "upgrade_obsolete": (upgrade_obsolete, "SELECT p_name, p_brand, p_type FROM part WHERE p_size <= 30 EXCEPT SELECT p_name, p_brand, p_type FROM part WHERE p_size >= 20"),
    "curation_superfluous": (curation_superfluous, "SELECT p_name, p_brand, p_type FROM part WHERE p_size <= 30 INTERSECT SELECT p_name, p_brand, p_type FROM part WHERE p_size >= 20"),
    "discrepancy_outer": (
        discrepancy_outer,
        """WITH h AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS text FROM supplier WHERE s_acctbal > 5000), a AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS text FROM customer WHERE c_acctbal > 9800)
        SELECT 's' AS kind, coalesce(h.text, a.text) AS text, CASE WHEN h.text IS NULL THEN 'auto' ELSE 'human' END AS side FROM h FULL JOIN a ON h.text = a.text WHERE h.text IS NULL OR a.text IS NULL""",
    ),
    "syn_stopwords": (_generated(S.drop_stop_words), _STOP_SQL),
    "syn_hyphenate": (_generated(S.hyphenate), _HYPHEN_SQL),
    "syn_replace": (_generated(S.replace_strings({"-": [" ", "_"], " NOS": [""]}, {" ": ["-"]})), _REPLACE_SQL),
    "syn_suffix": (_generated(S.swap_suffixes(_SUFFIXES)), _SUFFIX_SQL),
    "syn_spelling": (syn_spelling, _SPELL_SQL),
    "syn_token_swap": (_generated(S.swap_tokens(_TOKENS)), _TOKEN_SQL),
    "syn_greek": (_generated(S.greek_variants), None),
    "syn_combined": (syn_combined, None),
    "autocurate_length": (_curated([S.length_limits(2, 30)]), _curated_sql(behaviour="CASE WHEN length(s) < 2 OR length(s) > 30 THEN 'DROP_FOR_LINKING' ELSE 'ADD_FOR_NER_AND_LINKING' END")),
    "autocurate_common_word": (_curated([S.common_words(_COMMON)]), _curated_sql(conf=_COMMON_SQL)),
    "autocurate_multiword": (_curated([S.acronyms, S.multiword]), _curated_sql(conf="CASE WHEN contains(trim(s), ' ') THEN 50 WHEN length(s) <= 5 AND s = upper(s) AND regexp_matches(s, '\\p{Lu}') THEN 10 ELSE 50 END")),
    "autocurate_acronym": (_curated([S.acronyms]), _curated_sql(conf="CASE WHEN length(s) <= 5 AND s = upper(s) AND regexp_matches(s, '\\p{Lu}') THEN 10 ELSE 50 END")),
    "autocurate_case": (
        _curated([S.symbolic_case(), S.capitals_ignore_case, S.mixed_case]),
        _curated_sql(cs=f"(({duck.symbolic('s')} AND NOT regexp_matches(s, '^\\p{{Lu}}+$')) OR regexp_matches(s, '^\\p{{Ll}}\\p{{Lu}}'))"),
    ),
}
