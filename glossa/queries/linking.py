"""Linking: exact and TF-IDF candidates, boolean scorers, mapping strategies, disambiguation, cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cascade as Q
from ..operators import link as L
from ..operators import strategies as T
from ..operators import vectors as E
from ..operators.common import checkpointed
from .fixtures import catalogue, lexicon, table
from .ner import MENTIONS, mentions


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.upper("p_name").alias("syn_norm")).distinct()


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name, and every name with a letter doubled, one missing and a number behind it."""
    n = F.col("syn_norm")
    forms = F.array(n, F.concat(F.substring(n, 1, 3), n), F.concat(F.substring(n, 1, 2), F.substring(n, 4, 100)), F.concat(n, F.lit(" 2")))
    return _names(spark, sf_dir).select(F.explode(forms).alias("match_norm")).distinct()


_QUERIES = """names AS (SELECT DISTINCT upper(p_name) AS n FROM part),
q AS (SELECT DISTINCT unnest([n, left(n, 3) || n, left(n, 2) || substring(n, 4), n || ' 2']) AS m FROM names)"""


def link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = _perturbed(spark, sf_dir), _names(spark, sf_dir)
    return q.join(k, q["match_norm"] == k["syn_norm"], "left").select("match_norm", F.col("syn_norm").isNotNull().alias("exact_match"))


def link_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = L.top_candidates(_perturbed(spark, sf_dir).select(F.col("match_norm").alias("query")), _names(spark, sf_dir), 5)
    return hits.select("query", "syn_norm", F.round("score", 6).alias("score"), "rank")


def _tfidf(keys: str, queries: str, grams) -> str:
    """CTEs ending in scored(m, n, score) for SELECTs of keys (n) and queries (m)."""
    return f"""tk AS ({keys}), tq AS ({queries}),
    kt AS (SELECT n, gram, count(*) AS tf FROM (SELECT n, unnest({grams('n')}) AS gram FROM tk) GROUP BY ALL),
    idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM tk)) / (1 + count(*))) + 1 AS idf FROM kt GROUP BY gram),
    kw AS (SELECT n, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY n)) AS w FROM kt JOIN idf USING (gram)),
    qt AS (SELECT m, gram, count(*) AS tf FROM (SELECT m, unnest({grams('m')}) AS gram FROM tq) GROUP BY ALL),
    qw AS (SELECT m, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY m)) AS w FROM qt JOIN idf USING (gram)),
    scored AS (SELECT m, n, 100 * sum(qw.w * kw.w) AS score FROM qw JOIN kw USING (gram) GROUP BY m, n)"""


def _pairs_sql(x: str) -> str:
    return f"list_transform(range(1, length({x})), lambda i: substring({x}, i, 2))"


_TOPK = f"WITH {_QUERIES}, {_tfidf('SELECT n FROM names', 'SELECT m FROM q', _pairs_sql)}"
_TOPK_SQL = _TOPK + """ SELECT m AS query, n AS syn_norm, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY m ORDER BY round(score, 6) DESC, n) AS INTEGER) AS rank FROM scored
QUALIFY rank <= 5 AND score > 0"""


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact links alone where there are any, else the search's, with equal numbers."""
    out = L.link(_perturbed(spark, sf_dir), _names(spark, sf_dir), 5, X.numbers_match)
    return out.select("match_norm", "syn_norm", "exact_match", F.coalesce(F.round("search_score", 6), F.lit(-1.0)).alias("search_score"))


_LINK_SQL = _TOPK + """, top AS (SELECT m, n, round(score, 6) AS score FROM scored WHERE m NOT IN (SELECT n FROM names)
  QUALIFY row_number() OVER (PARTITION BY m ORDER BY round(score, 6) DESC, n) <= 5 AND score > 0)
SELECT m AS match_norm, n AS syn_norm, false AS exact_match, score AS search_score FROM top
WHERE list_sort(regexp_extract_all(m, '[0-9]+')) = list_sort(regexp_extract_all(n, '[0-9]+'))
UNION ALL SELECT m, m, true, -1.0 FROM q WHERE m IN (SELECT n FROM names)"""

#: Two vocabularies of products and one of companies; product strings are sought in the first two.
_SHELVES = {"small": "p_size < 26", "large": "p_size >= 26"}


def link_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from each vocabulary of the mention's class, with an index for each."""
    parts = table(spark, sf_dir, "part")
    names = [parts.filter(c).select(F.lit(p).alias("parser"), F.lit("product").alias("entity_class"), F.upper("p_name").alias("syn_norm")) for p, c in _SHELVES.items()]
    firms = table(spark, sf_dir, "supplier").select(F.lit("firms").alias("parser"), F.lit("company").alias("entity_class"), F.upper("s_name").alias("syn_norm"))
    cands = names[0].unionByName(names[1]).unionByName(firms).distinct()
    out = L.link_by_class(_perturbed(spark, sf_dir).withColumn("entity_class", F.lit("product")), cands, 5, X.numbers_match)
    return out.select("parser", "entity_class", "match_norm", "syn_norm", "exact_match", F.coalesce(F.round("search_score", 6), F.lit(-1.0)).alias("search_score"))


def _shelf_sql(parser: str, where: str) -> str:
    own = f"SELECT DISTINCT upper(p_name) AS n FROM part WHERE {where}"
    return f"""SELECT '{parser}' AS parser, 'product' AS entity_class, * FROM (WITH {_QUERIES}, shelf AS ({own}), {_tfidf('SELECT n FROM shelf', 'SELECT m FROM q', _pairs_sql)},
    top AS (SELECT m, n, round(score, 6) AS score FROM scored WHERE m NOT IN (SELECT n FROM shelf)
      QUALIFY row_number() OVER (PARTITION BY m ORDER BY round(score, 6) DESC, n) <= 5 AND score > 0)
    SELECT m AS match_norm, n AS syn_norm, false AS exact_match, score AS search_score FROM top
    WHERE list_sort(regexp_extract_all(m, '[0-9]+')) = list_sort(regexp_extract_all(n, '[0-9]+'))
    UNION ALL SELECT m, m, true, -1.0 FROM q WHERE m IN (SELECT n FROM shelf))"""


_BY_CLASS_SQL = " UNION ALL ".join(_shelf_sql(p, c) for p, c in _SHELVES.items())

_TERMS = ("IL 2 TYPE 1 RECEPTOR", "IL 2", "TYPE I COLLAGEN", "TYPE 2 COLLAGEN LIKE", "RECEPTOR 2 1", "RECEPTOR 1 2", "GENE", "", "SUBUNIT 7 OF 7", "TYPE 1 TYPE 1")
_TERMS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in _TERMS) + ") AS t(s)"


def _boolean(test):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = spark.createDataFrame([(s,) for s in _TERMS], "a string")
        pairs = a.join(F.broadcast(a.select(F.col("a").alias("b"))))
        return pairs.select("a", "b", test(F.col("a"), F.col("b")).alias("accepted"))

    return query


def _boolean_sql(test: str) -> str:
    return f"WITH t AS ({_TERMS_SQL}) SELECT x.s AS a, y.s AS b, {test} AS accepted FROM t x, t y"


_NUM_SQL = _boolean_sql("list_sort(regexp_extract_all(x.s, '[0-9]+')) = list_sort(regexp_extract_all(y.s, '[0-9]+'))")
_TYPES = "regexp_extract_all({}.s, 'TYPE (?:I|[0-9]+)')"
_SUB_SQL = f"""WITH t AS ({_TERMS_SQL}), c AS (SELECT s, {_TYPES.format('t')} AS ts FROM t)
SELECT x.s AS a, y.s AS b, len(list_filter(x.ts, lambda p: len(list_filter(y.ts, lambda r: r = p)) < len(list_filter(x.ts, lambda r: r = p)))) = 0 AS accepted FROM c x, c y"""
_MOD_SQL = _boolean_sql(" AND ".join(f"contains(x.s, '{m}') = contains(y.s, '{m}')" for m in X.MODIFIERS))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates of the perturbed names as mention keys."""
    hits = L.top_candidates(_perturbed(spark, sf_dir).select(F.col("match_norm").alias("query")), _names(spark, sf_dir), 10)
    return hits.select(
        F.col("query").alias("key"), F.lit("parts").alias("parser"), "syn_norm", F.col("query").alias("match_norm"),
        (F.col("query") == F.col("syn_norm")).alias("exact_match"), F.round("score", 6).alias("search_score"), (F.length("syn_norm") % 2 == 0).alias("is_symbolic"),
    )


_LINKS = _TOPK + """, links AS (SELECT m AS key, n AS syn_norm, round(score, 6) AS search_score, m = n AS exact_match, length(n) % 2 = 0 AS is_symbolic
  FROM scored QUALIFY row_number() OVER (PARTITION BY m ORDER BY round(score, 6) DESC, n) <= 10 AND score > 0)"""


def map_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exact_match(_links(spark, sf_dir)).select("key", "syn_norm")


def map_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.symbol_match(_links(spark, sf_dir)).select("key", "syn_norm")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the names as candidates of the names."""
    n = table(spark, sf_dir, "part").select(F.upper("p_name").alias("key")).distinct()
    w = n.select(F.explode(F.split("key", " ")).alias("syn_norm")).distinct()
    return n.join(F.broadcast(w)).select("key", F.lit("parts").alias("parser"), "syn_norm", F.col("key").alias("match_norm"))


def map_subtoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.subtoken_match(_words(spark, sf_dir)).select("key", "syn_norm")


_SUBTOKEN_SQL = """WITH n AS (SELECT DISTINCT upper(p_name) AS key FROM part), w AS (SELECT DISTINCT unnest(string_split(key, ' ')) AS syn_norm FROM n),
h AS (SELECT key, syn_norm, length(syn_norm) AS len FROM n JOIN w ON list_contains(string_split(key, ' '), syn_norm) WHERE length(syn_norm) >= 3),
a AS (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY key, len) = 1)
SELECT key, syn_norm FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY len DESC) = 1"""


def map_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.strong_match(_links(spark, sf_dir), 60.0, 5.0).select("key", "syn_norm", "search_score")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors whose id is divisible by 20 as mentions, all others with the same label as candidates."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("key"), F.col("embedding").alias("q"), "label")
    return q, e.select(F.col("vec_id").alias("idx"), (F.col("vec_id") % 50).alias("set_key"), F.col("embedding").alias("c"), "label")


def _near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mention and set of candidates those that are most similar: all that the strategies below look at."""
    return E.nearest_in_sets(*_vectors(spark, sf_dir), "label").withColumn("parser", F.lit("vectors"))


_VECTORS = """WITH pairs AS (SELECT q.vec_id AS key, c.vec_id AS idx, c.vec_id % 50 AS set_key,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)"""


def map_strong_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _near_vectors(spark, sf_dir).withColumns({"search_score": 100 * F.col("similarity"), "syn_norm": F.col("idx")})
    return T.strong_match_confirmed(p, "similarity", 0.3, threshold=20.0, margin=15.0).select("key", "idx", "set_key")


_EMBED_SQL = _VECTORS + """, s AS (SELECT * FROM pairs QUALIFY 100 * similarity >= 20 AND max(100 * similarity) OVER (PARTITION BY key) - 100 * similarity <= 15)
SELECT key, idx, set_key FROM s QUALIFY row_number() OVER (PARTITION BY key, set_key ORDER BY similarity DESC, idx) = 1 AND similarity >= 0.3"""


def disamb_nearest_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.by_similarity(_near_vectors(spark, sf_dir), "similarity").select("key", "idx")


def disamb_context_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _vectors(spark, sf_dir)
    top = T.context_gap_sets(_near_vectors(spark, sf_dir), "similarity").join(q.select("key", "label"), "key")
    return top.join(c, ["label", "set_key"]).filter("key <> idx").select("key", "idx", "set_key")


_GAP_SQL = _VECTORS + """, g AS (SELECT key, set_key, max(similarity) AS s FROM pairs GROUP BY ALL),
r AS (SELECT *, lead(s) OVER w AS nxt, row_number() OVER w AS r FROM g WINDOW w AS (PARTITION BY key ORDER BY s DESC, set_key))
SELECT p.key, p.idx, p.set_key FROM pairs p JOIN r ON p.key = r.key AND p.set_key = r.set_key WHERE r = 1 AND (nxt IS NULL OR s - nxt >= 0.01)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id sets of the ambiguous catalogue: a set per brand of each name."""
    c = catalogue(spark, sf_dir)
    return c.select(F.upper("syn").alias("key"), "parser", "idx", F.col("source").alias("set_key"), "default_label", "annotation_score")


def disamb_annotation_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sets(spark, sf_dir)
    return T.by_annotation(s.drop("annotation_score"), s).select("key", "set_key", "idx")


_ANNOT_SQL = """WITH s AS (SELECT upper(p_name) AS key, p_brand AS set_key, CAST(p_partkey AS VARCHAR) AS idx, p_size FROM part),
a AS (SELECT key, set_key, max(p_size) AS m FROM s GROUP BY key, set_key),
g AS (SELECT * FROM a QUALIFY rank() OVER (PARTITION BY key ORDER BY m DESC) = 1)
SELECT key, set_key, idx FROM s JOIN g USING (key, set_key)"""


def disamb_default_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as ids; those whose name has the nation's number are preferred."""
    s = table(spark, sf_dir, "supplier")
    label = F.concat(F.lit("S "), (F.col("s_suppkey") % 5).cast("string"))
    rows = s.select(F.col("s_nationkey").alias("key"), F.lit("s").alias("parser"), F.col("s_suppkey").alias("idx"), F.lit("all").alias("set_key"), F.concat(F.lit("S "), (F.col("s_nationkey") % 5).cast("string")).alias("match_norm"))
    labels = s.select(F.lit("s").alias("parser"), F.col("s_suppkey").alias("idx"), label.alias("label"))
    return T.by_default_label(rows, labels, F.upper("label")).select("key", "idx", "set_key")


def disamb_defined_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: of a line's supplier sets those stay that another line of the order maps."""
    li = table(spark, sf_dir, "lineitem")
    sets = li.select(F.col("l_orderkey").alias("doc_id"), F.lit("s").alias("parser"), F.col("l_linenumber").alias("key"), F.col("l_suppkey").alias("idx"))
    mapped = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.lit("s").alias("parser"), F.col("l_suppkey").alias("idx"))
    return T.defined_elsewhere(sets, mapped).select("doc_id", "key", "idx")


def disamb_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type of parts, the name that is most like the joined names of its brand."""
    p = table(spark, sf_dir, "part")
    docs = p.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("context"))
    pairs = p.select("p_type", F.col("p_name").alias("syn_norm"), F.col("p_brand").alias("set_key")).distinct().join(docs, "p_type")
    scored = L.text_similarity(pairs, "context", "syn_norm", X.context_grams).withColumn("cosine", F.round("cosine", 6))
    syns = scored.select(F.col("p_type").alias("key"), F.lit("parts").alias("parser"), "syn_norm", F.concat_ws(":", "syn_norm", F.length("set_key").cast("string")).alias("set_key"), "cosine")
    return T.by_best_synonym(syns, "cosine", 0.05).select("key", "set_key")


def _context_sql(x: str) -> str:
    w = f"string_split({x}, ' ')"
    return (
        f"list_concat(list_concat({w}, list_transform(range(1, len({w})), lambda i: array_to_string(list_slice({w}, i, i + 1), ' '))),"
        f" list_concat({_pairs_sql(x)}, list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3))))"
    )


_DISAMB_TFIDF_SQL = f"""WITH docs AS (SELECT p_type, array_to_string(list_sort(list(DISTINCT p_name)), ' ') AS m FROM part GROUP BY ALL),
{_tfidf('SELECT DISTINCT p_name AS n FROM part', 'SELECT DISTINCT m FROM docs', _context_sql)},
p AS (SELECT DISTINCT p_type AS key, p_name AS n, p_name || ':' || length(p_brand) AS set_key, docs.m FROM part JOIN docs USING (p_type)),
s AS (SELECT p.*, round(coalesce(score, 0) / 100, 6) AS c FROM p LEFT JOIN scored USING (m, n)),
g AS (SELECT key, n, max(c) AS c, count(DISTINCT set_key) AS k, min(set_key) AS set_key FROM s WHERE c >= 0.05 GROUP BY key, n)
SELECT key, set_key FROM g WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, n) = 1"""


def xref_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to the suppliers of their line items, where the supplier is known."""
    li = table(spark, sf_dir, "lineitem")
    maps = table(spark, sf_dir, "part").select(F.lit("P").alias("source"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("default_label"))
    xrefs = li.select(F.lit("P").alias("source"), F.col("l_partkey").alias("idx"), F.lit("S").alias("target_source"), F.col("l_suppkey").alias("target_idx")).distinct()
    meta = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.lit("S").alias("source"), F.col("s_suppkey").alias("idx"), F.col("s_name").alias("default_label"))
    return L.expand_xrefs(maps, xrefs, meta).groupBy("source", "idx", "default_label", "xref_source").agg(F.count("*").alias("n"))


_XREF_SQL = """WITH x AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'S' AS source, s_suppkey AS idx, s_name AS default_label, 'P' AS xref_source, count(*) AS n FROM x JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY ALL"""


def _mention_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(links, sets) of the lexicon's mentions at the grain (document, string, class)."""
    m = mentions(spark, sf_dir).groupBy("doc_id", F.lower("match").alias("low"), "entity_class").agg(F.max("confidence").alias("confidence"))
    m = m.withColumn("key", F.concat_ws("|", "doc_id", "low", "entity_class"))
    lex = lexicon(spark).filter("not case_sensitive").select("parser", F.col("entity_class"), F.upper("syn").alias("syn_norm"), F.lower("syn").alias("low"), "idx", "annotation_score")
    both = checkpointed(m.join(F.broadcast(lex), ["low", "entity_class"]).select("key", "doc_id", "parser", "syn_norm", "idx", "confidence"))
    sets = both.select("key", "doc_id", "parser", "syn_norm", F.col("idx").alias("set_key"), "idx")
    links = both.select("key", "doc_id", "parser", "syn_norm", "confidence", F.lit(False).alias("symbolic"), F.lit(True).alias("exact_match")).distinct()
    return links, sets


def strategy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident mentions map exactly, then by annotation; unsure ones only to what the document has already."""
    links, sets = _mention_keys(spark, sf_dir)
    scores = lexicon(spark).select("parser", "idx", "annotation_score")

    def annotated(s: DataFrame, mapped: DataFrame) -> DataFrame:
        return T.by_annotation(s, scores)

    def elsewhere(s: DataFrame, mapped: DataFrame) -> DataFrame:
        return T.defined_elsewhere(s, mapped)

    levels = [
        Q.Level(100, False, [Q.Strategy("exact", T.exact_match, [("annotation", annotated)])]),
        Q.Level(50, False, [Q.Strategy("exact", T.exact_match, [("elsewhere", elsewhere), ("annotation", annotated)])]),
        Q.Level(10, False, [Q.Strategy("exact_essential", T.exact_match, [("elsewhere", elsewhere)], essential=True)]),
    ]
    out = Q.run(links, sets, levels, cut=checkpointed)
    return out.select("key", "parser", "idx", "strategy", "disambiguation", F.coalesce("disambiguation_confidence", F.lit("")).alias("disambiguation_confidence"))


_CASCADE_SQL = MENTIONS + """, m AS (SELECT doc_id, lower(match) AS low, entity_class, max(confidence) AS confidence FROM mentions GROUP BY ALL),
b AS (SELECT doc_id || '|' || low || '|' || m.entity_class AS key, doc_id, m.confidence, parser, idx, annotation_score,
  count(*) OVER (PARTITION BY doc_id, low, m.entity_class, parser) AS n_sets,
  rank() OVER (PARTITION BY doc_id, low, m.entity_class, parser ORDER BY annotation_score DESC) AS r
  FROM m JOIN lex ON low = lower(syn) AND m.entity_class = lex.entity_class AND NOT lex.case_sensitive),
b2 AS (SELECT *, count(*) FILTER (r = 1) OVER (PARTITION BY key, parser) AS n_best FROM b),
hi AS (SELECT key, doc_id, parser, idx, 'exact' AS strategy, CASE WHEN n_sets = 1 THEN 'not_required' WHEN n_best = 1 THEN 'annotation' ELSE 'none' END AS d
  FROM b2 WHERE confidence = 100 AND (n_best > 1 OR r = 1)),
p1 AS (SELECT *, EXISTS (SELECT 1 FROM hi WHERE hi.doc_id = b2.doc_id AND hi.parser = b2.parser AND hi.idx = b2.idx) AS seen FROM b2 WHERE confidence = 50),
p2 AS (SELECT *, count(*) FILTER (seen) OVER (PARTITION BY key, parser) AS n_seen FROM p1),
mid AS (SELECT key, doc_id, parser, idx, 'exact' AS strategy,
  CASE WHEN n_sets = 1 THEN 'not_required' WHEN n_seen = 1 THEN 'elsewhere' WHEN n_best = 1 THEN 'annotation' ELSE 'none' END AS d
  FROM p2 WHERE n_sets = 1 OR (n_seen = 1 AND seen) OR (n_seen <> 1 AND (n_best > 1 OR r = 1))),
so AS (SELECT * FROM hi UNION ALL SELECT * FROM mid),
lo AS (SELECT *, EXISTS (SELECT 1 FROM so WHERE so.doc_id = b2.doc_id AND so.parser = b2.parser AND so.idx = b2.idx) AS seen FROM b2 WHERE confidence = 10),
lo2 AS (SELECT *, count(*) FILTER (seen) OVER (PARTITION BY key, parser) AS n_seen FROM lo),
allm AS (SELECT * FROM so UNION ALL SELECT key, doc_id, parser, idx, 'exact_essential', 'elsewhere' FROM lo2 WHERE seen AND n_seen = 1)
SELECT DISTINCT key, parser, idx, strategy, d AS disambiguation, CASE d WHEN 'not_required' THEN '' WHEN 'none' THEN 'AMBIGUOUS' ELSE 'HIGHLY_LIKELY' END AS disambiguation_confidence FROM allm
"""

CATALOGUE = {
    "link_exact": (link_exact, f"WITH {_QUERIES} SELECT m AS match_norm, m IN (SELECT n FROM names) AS exact_match FROM q"),
    "link_tfidf_topk": (link_tfidf_topk, _TOPK_SQL),
    "link_by_class": (link_by_class, _BY_CLASS_SQL),
    "link_candidates": (link_candidates, _LINK_SQL),
    "bool_number": (_boolean(X.numbers_match), _NUM_SQL),
    "bool_subtype": (_boolean(X.subtypes_match), _SUB_SQL),
    "bool_modifier": (_boolean(X.modifiers_match), _MOD_SQL),
    "map_exact": (map_exact, _LINKS + " SELECT key, syn_norm FROM links WHERE exact_match"),
    "map_symbol": (map_symbol, None),
    "map_subtoken": (map_subtoken, _SUBTOKEN_SQL),
    "map_strong": (map_strong, _LINKS + " SELECT key, syn_norm, search_score FROM links QUALIFY search_score >= 60 AND max(search_score) OVER (PARTITION BY key) - search_score <= 5"),
    "map_strong_embed": (map_strong_embed, _EMBED_SQL),
    "disamb_defined_elsewhere": (
        disamb_defined_elsewhere,
        """SELECT l_orderkey AS doc_id, l_linenumber AS key, l_suppkey AS idx FROM lineitem a WHERE EXISTS
          (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'R')""",
    ),
    "disamb_tfidf": (disamb_tfidf, _DISAMB_TFIDF_SQL),
    "disamb_context_gap": (disamb_context_gap, _GAP_SQL),
    "disamb_annotation_level": (disamb_annotation_level, _ANNOT_SQL),
    "disamb_default_label": (
        disamb_default_label,
        "SELECT s_nationkey AS key, s_suppkey AS idx, 'label' AS set_key FROM supplier WHERE s_suppkey % 5 = s_nationkey % 5",
    ),
    "disamb_nearest_embedding": (disamb_nearest_embedding, _VECTORS + " SELECT key, idx FROM pairs QUALIFY rank() OVER (PARTITION BY key ORDER BY similarity DESC) = 1"),
    "xref_expand": (xref_expand, _XREF_SQL),
    "strategy_cascade": (strategy_cascade, _CASCADE_SQL),
}
