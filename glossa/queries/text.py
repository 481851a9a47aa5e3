"""Sections, tokens, n-grams, normalisation and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as X
from ..operators import tokens as K
from . import duck
from .fixtures import STRINGS, sections, strings, table


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", "section_idx", "name", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))


def doc_length_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, late = K.admit(table(spark, sf_dir, "documents"), 10_000)
    return ok.select("doc_id", F.lit(True).alias("admitted")).unionByName(late.select("doc_id", F.lit(False).alias("admitted")))


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.max(n).alias("max_length"), F.round(F.avg(n), 6).alias("mean_length"), F.count("*").alias("n_docs")
    )


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.token_rows(sections(spark, sf_dir))


def tokenize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(spark, sf_dir).select("doc_id", "start", "end", "token")


def token_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.min("start").alias("first_start"), F.max("end").alias("last_end"),
        F.sum(F.col("end") - F.col("start")).alias("token_chars"),
    )


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sentences(sections(spark, sf_dir)).select("doc_id", "sentence_idx", "start", "end")


_SENTENCES_SQL = r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+)(\s+)', '\1\2' || chr(1), 'g'), chr(1)) AS ps FROM documents WHERE length(text) > 0),
q AS (SELECT doc_id, unnest(ps) AS w, generate_subscripts(ps, 1) AS i FROM p),
r AS (SELECT doc_id, i, w, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) - length(w) AS s FROM q)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_idx, CAST(s AS INTEGER) AS start, CAST(s + length(rtrim(w, ' ')) AS INTEGER) AS "end"
FROM r WHERE length(rtrim(w, ' ')) > 0
"""


def _ngrams(make) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strings(spark, sf_dir).select("s", F.explode(make(F.col("s"))).alias("gram")).groupBy("s", "gram").agg(F.count("*").alias("n"))

    return query


def _char_sql(x: str, n: int) -> str:
    return f"list_transform(range(1, length({x}) - {n - 2}), lambda i: substring({x}, i, {n}))"


def _word_sql(x: str, n: int) -> str:
    w = f"string_split({x}, ' ')"
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' '))"


def _grams_sql(expr: str) -> str:
    return f"WITH src AS ({STRINGS}), g AS (SELECT s, unnest({expr}) AS gram FROM src) SELECT s, gram, count(*) AS n FROM g GROUP BY s, gram"


def _normalizer(cls: str | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strings(spark, sf_dir).select("s", N.normalize(F.col("s"), cls).alias("norm"))

    return query, f"WITH {duck.normalized(STRINGS, cls)} SELECT s, norm FROM normed"


def classify_symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (None, "gene", "disease", "company", "anatomy")
    return strings(spark, sf_dir).select("s", *(N.classify_symbolic(F.col("s"), k).alias(f"is_{k or 'default'}") for k in kinds))


_SYMBOLIC_SQL = f"WITH src AS ({STRINGS}) SELECT s, " + ", ".join(
    f"{duck.symbolic('s', k)} AS is_{k or 'default'}" for k in (None, "gene", "disease", "company", "anatomy")
) + " FROM src"


def depluralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _token_rows(spark, sf_dir).select("token").distinct()
    return words.select("token", N.depluralize(F.col("token")).alias("singular"))


def uri_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_uri(F.col("url")).alias("local_name"))


_URI_SQL = r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:')
  THEN string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?', ''), '/')[-1]
  ELSE url END AS local_name FROM pages
"""


def curie_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.col("p_brand"), F.lit(":"), F.col("p_partkey").cast("string"))
    src, idx = X.curie_parts(c, {"Brand#11": "eleven"})
    return table(spark, sf_dir, "part").select("p_partkey", src.alias("source"), idx.alias("idx"))


def find_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", X.id_source(F.col("n_name")).alias("source"))


CATALOGUE = {
    "doc_sections": (doc_sections, "SELECT doc_id, CAST(0 AS INTEGER) AS section_idx, 'na' AS name, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars FROM documents"),
    "doc_length_prefilter": (doc_length_prefilter, "SELECT doc_id, coalesce(length(text), 0) < 10000 AS admitted FROM documents"),
    "batch_metrics": (
        batch_metrics,
        "SELECT source, CAST(max(length(text)) AS INTEGER) AS max_length, round(avg(length(text)), 6) AS mean_length, count(*) AS n_docs FROM documents GROUP BY source",
    ),
    "tokenize_offsets": (tokenize_offsets, f'WITH {duck.tokens()} SELECT doc_id, s AS start, e AS "end", w AS token FROM tok'),
    "token_boundaries": (
        token_boundaries,
        f"WITH {duck.tokens()} SELECT doc_id, count(*) AS n_tokens, min(s) AS first_start, max(e) AS last_end, CAST(sum(e - s) AS BIGINT) AS token_chars FROM tok GROUP BY doc_id",
    ),
    "sentence_spans": (sentence_spans, _SENTENCES_SQL),
    "char_ngrams": (_ngrams(X.char_ngrams), _grams_sql(_char_sql("s", 2))),
    "word_ngrams": (_ngrams(X.word_ngrams), _grams_sql(_word_sql("s", 2))),
    "word_char_ngrams": (
        _ngrams(X.context_grams),
        _grams_sql(f"list_concat(list_concat({_word_sql('s', 1)}, {_word_sql('s', 2)}), list_concat({_char_sql('s', 2)}, {_char_sql('s', 3)}))"),
    ),
    "normalize_default": _normalizer(None),
    "normalize_gene": _normalizer("gene"),
    "normalize_disease": _normalizer("disease"),
    "normalize_anatomy": _normalizer("anatomy"),
    "normalize_company": _normalizer("company"),
    "classify_symbolic": (classify_symbolic, _SYMBOLIC_SQL),
    "depluralize": (depluralize, f"WITH {duck.tokens()}, t AS (SELECT DISTINCT w FROM tok) SELECT w AS token, {duck.singular('w')} AS singular FROM t"),
    "uri_strip": (uri_strip, _URI_SQL),
    "curie_split": (
        curie_split,
        "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'eleven' ELSE string_split(p_brand, ':')[1] END AS source, CAST(p_partkey AS VARCHAR) AS idx FROM part",
    ),
    "find_source": (find_source, "SELECT n_nationkey, string_split(n_name, '_')[1] AS source FROM nation"),
}
