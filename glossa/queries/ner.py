"""Mentions: dictionary matches, filters, label spans, splitting, abbreviations, votes, cleanup, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ner as M
from ..operators import post as P
from ..operators import tokens as K
from . import duck
from .fixtures import LEXICON, dictionary, lexicon, sections, table

JOIN = lambda c: F.array_join(c, ",")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon's mentions in all documents, with ent_id."""
    return M.dictionary_match(sections(spark, sf_dir), dictionary(spark), 2).withColumn("ent_id", M.mention_id())


_GRAMS = f"""{duck.tokens()}, grams AS (
  SELECT doc_id, s, e, w AS g FROM tok UNION ALL
  SELECT doc_id, s, CAST(e + length(gap) + length(w2) AS INTEGER), w || gap || w2 FROM tok WHERE w2 IS NOT NULL
), lex AS ({LEXICON}), hits AS (
  SELECT doc_id, s, e, g, lex.* FROM grams JOIN lex ON lower(g) = lower(syn) WHERE NOT case_sensitive OR g = syn
), mentions AS (
  SELECT doc_id, s, e, entity_class, max(g) AS match, max(confidence) AS confidence,
    array_to_string(list_sort(list(DISTINCT parser || '|' || upper(syn))), ',') AS candidates
  FROM hits GROUP BY doc_id, s, e, entity_class
)"""
#: CTEs ending in mentions(doc_id, s, e, entity_class, match, confidence, candidates).
MENTIONS = "WITH " + _GRAMS


def dict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("doc_id", "start", "end", "entity_class", "match", "confidence", JOIN("candidates").alias("candidates"))


def dict_match_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dictionary(spark).filter("case_sensitive")
    return M.dictionary_match(sections(spark, sf_dir), own, 2).select("doc_id", "start", "end", "match")


def dict_match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("doc_id", "entity_class").agg(F.max("confidence").alias("best"), F.count("*").alias("n"))


def mention_counts_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("entity_class").agg(
        F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"), F.max("confidence").alias("max_confidence")
    )


def _in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = sections(spark, sf_dir)
    return M.sentence_context(mentions(spark, sf_dir), K.sentences(secs), secs)


#: CTEs ending in placed(mention..., sentence).
_PLACED = MENTIONS + r""", sp AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?]+)(\s+)', '\1\2' || chr(1), 'g'), chr(1)) AS ps FROM documents WHERE length(text) > 0
), sq AS (SELECT doc_id, unnest(ps) AS w, generate_subscripts(ps, 1) AS i FROM sp),
sr AS (SELECT doc_id, i, w, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS INTEGER) AS ss FROM sq),
placed AS MATERIALIZED (
  SELECT m.*, CASE WHEN m.s < sr.ss + length(rtrim(sr.w, ' ')) THEN rtrim(sr.w, ' ') ELSE (SELECT text FROM documents d WHERE d.doc_id = m.doc_id) END AS sentence
  FROM mentions m ASOF LEFT JOIN (SELECT * FROM sr WHERE length(rtrim(w, ' ')) > 0) sr ON m.doc_id = sr.doc_id AND m.s >= sr.ss)
"""


def cooccurrence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = M.context_filter(
        _in_sentences(spark, sf_dir), tp_words={"insult": ["the", "of", "und", "le"]}, fp_words={"gene": ["was", "is"]}, fp_patterns={"place": r"der\s+die"}
    )
    return kept.select("doc_id", "start", "end", "entity_class", "match")


_COOC_SQL = _PLACED + r"""
SELECT doc_id, s AS start, e AS "end", entity_class, match FROM placed
WHERE NOT (entity_class = 'insult' AND NOT regexp_matches(lower(sentence), '(^|[^\p{L}\p{N}])(the|of|und|le)($|[^\p{L}\p{N}])'))
  AND NOT (entity_class = 'gene' AND regexp_matches(lower(sentence), '(^|[^\p{L}\p{N}])(was|is)($|[^\p{L}\p{N}])'))
  AND NOT (entity_class = 'place' AND regexp_matches(lower(sentence), 'der\s+die'))
"""
_RULES = [
    ("insult", None, "tp", "(the|le|der|la) "),
    ("gene", "with", "fp", "with the"),
    ("link", None, "fp", "of the of"),
    ("function", "and", "tp", "and the"),
]
_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {'NULL' if m is None else repr(m)}, '{k}', '{p}')" for c, m, k, p in _RULES) + ") AS r(entity_class, rule_match, kind, pattern)"


def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "entity_class string, match string, kind string, pattern string")
    return M.rule_filter(_in_sentences(spark, sf_dir), rules).select("doc_id", "start", "end", "entity_class", "match")


_RULE_FILTER_SQL = _PLACED + f""", rules AS ({_RULES_SQL}), verdicts AS (
  SELECT doc_id, match, p.entity_class, kind, rule_match IS NULL AS wide, bool_or(regexp_matches(lower(sentence), pattern)) AS hit
  FROM placed p JOIN rules r ON p.entity_class = r.entity_class AND (rule_match IS NULL OR rule_match = match)
  GROUP BY ALL
), bad AS (SELECT DISTINCT doc_id, match, entity_class FROM verdicts WHERE (kind = 'fp' AND hit) OR (kind = 'tp' AND NOT hit))
SELECT doc_id, s AS start, e AS "end", entity_class, match FROM placed p
WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = p.doc_id AND b.match = p.match AND b.entity_class = p.entity_class)
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a label that depends on their length: B, I and O of two classes."""
    n = F.length("token") % 7
    label = F.when(n == 1, "B-x").when(n == 2, "I-x").when(n == 3, "I-y").when(n == 4, "B-y").otherwise("O")
    return K.token_rows(sections(spark, sf_dir)).withColumn("label", label)


_LABELS = f"""WITH {duck.tokens()}, lab AS (
  SELECT doc_id, i // 2 - 1 AS pos, s, e, CASE length(w) % 7 WHEN 1 THEN 'B-x' WHEN 2 THEN 'I-x' WHEN 3 THEN 'I-y' WHEN 4 THEN 'B-y' ELSE 'O' END AS label,
    coalesce(lag(gap) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM tok
)"""


def bio_spans_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_spans(_labelled(spark, sf_dir)).select("doc_id", "entity_class", "start", "end", "n")


_BIO_SQL = _LABELS + """, a AS (
  SELECT *, CASE WHEN label = 'O' THEN NULL ELSE substring(label, 3) END AS cls FROM lab
), b AS (SELECT *, lag(cls) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM a),
c AS (SELECT *, sum(CASE WHEN cls IS NOT NULL AND (translate(before, '();', '') <> before OR cls IS DISTINCT FROM prev) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b),
d AS (SELECT * FROM c WHERE cls IS NOT NULL),
f AS (SELECT *, sum(CASE WHEN label[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY pos) AS part,
  min(pos) OVER (PARTITION BY doc_id, island) AS first FROM d)
SELECT doc_id, cls AS entity_class, min(s) AS start, max(e) AS "end", count(*) AS n FROM d GROUP BY doc_id, cls, island
UNION
SELECT doc_id, cls, min(s), max(e), count(*) FROM f GROUP BY doc_id, cls, island, part HAVING min(pos) > max(first)
"""


def bio_spans_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _labelled(spark, sf_dir)
    some = F.array_compact(F.array(F.when(F.length("token") % 2 == 0, F.lit("even")), F.when(F.length("token") % 3 == 0, F.lit("third"))))
    return M.multilabel_spans(w.withColumn("labels", some)).select("doc_id", "entity_class", "start", "end", "n")


_MULTI_SQL = f"""WITH {duck.tokens()}, l AS (
  SELECT doc_id, i // 2 - 1 AS pos, s, e, 'even' AS cls FROM tok WHERE length(w) % 2 = 0
  UNION ALL SELECT doc_id, i // 2 - 1, s, e, 'third' FROM tok WHERE length(w) % 3 = 0
), r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, cls ORDER BY pos) AS island FROM l)
SELECT doc_id, cls AS entity_class, min(s) AS start, max(e) AS "end", count(*) AS n FROM r GROUP BY doc_id, cls, island"""


def split_numeric_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with sizes, such as ``Brand#11/2/3``."""
    p = table(spark, sf_dir, "part")
    listed = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string"))
    return p.select("p_partkey", F.explode(M.split_number_list(listed)).alias("part_name"))


_SPLIT_SQL = r"""
SELECT p_partkey, unnest([p_brand, regexp_replace(p_brand, '[0-9]+$', '') || p_size, regexp_replace(p_brand, '[0-9]+$', '') || (p_size + 1)]) AS part_name
FROM part WHERE regexp_matches(p_brand, '[0-9]$')
UNION ALL SELECT p_partkey, concat_ws('/', p_brand, p_size, p_size + 1) FROM part WHERE NOT regexp_matches(p_brand, '[0-9]$')
"""


def _defining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that define their first words: ``<text> (<initials>)``, from part names and comments."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    short = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    text = F.concat(F.col("p_name"), F.lit(" ("), short, F.lit(") is made. The "), short, F.lit(" is sold by "), F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("section_idx"), text.alias("text"))


def abbrev_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.abbreviations(_defining(spark, sf_dir))


_ABBREV_SQL = """
SELECT p_partkey AS doc_id, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '')) AS short, p_name AS long
FROM part WHERE len(string_split(p_name, ' ')) BETWEEN 2 AND 9
"""


_PROPAGATE_SQL = """
WITH p AS (SELECT p_partkey AS doc_id, p_name AS n, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '')) AS sh FROM part
  WHERE len(string_split(p_name, ' ')) BETWEEN 2 AND 9),
q AS (SELECT doc_id, 0 AS s, length(n) AS k, n AS match, 'dictionary' AS namespace FROM p
  UNION ALL SELECT doc_id, length(n) + 2, length(sh), sh, 'abbreviation' FROM p
  UNION ALL SELECT doc_id, length(n) + length(sh) + 17, length(sh), sh, 'abbreviation' FROM p)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(s + k AS INTEGER) AS "end", match, 'product' AS entity_class, namespace FROM q
"""


def abbrev_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = _defining(spark, sf_dir)
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    d = names.select(
        F.lit("parts").alias("parser"), F.lit("product").alias("entity_class"), F.upper("p_name").alias("syn_norm"), F.col("p_name").alias("text"),
        F.lit(False).alias("case_sensitive"), F.lit(50).alias("confidence"),
    )
    found = M.dictionary_match(secs, d)
    return M.propagate_abbreviations(found, secs).select("doc_id", "start", "end", "match", "entity_class", "namespace")


_EVENT_CLASSES = "SELECT user_id AS match, event_type AS entity_class, value AS score FROM events"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("match"), F.col("event_type").alias("entity_class"), F.col("value").alias("score"))


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.majority_vote(_votes(spark, sf_dir))


def max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.max_score(_votes(spark, sf_dir))


def cleanup_min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_where(mentions(spark, sf_dir), P.shorter_than(3)).select("doc_id", "start", "end", "entity_class", "match")


def cleanup_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_where(mentions(spark, sf_dir), P.other_class(["gene", "insult"])).select("doc_id", "start", "end", "entity_class", "match")


def cleanup_stoplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("function", "the"), ("gene", "on"), ("link", "and")], "entity_class string, word string")
    return P.drop_listed(mentions(spark, sf_dir), words).select("doc_id", "start", "end", "entity_class", "match")


def mapped(spark: SparkSession, ments: DataFrame) -> DataFrame:
    """Mappings of mentions to lexicon ids: unambiguous where the string and class have one id in its parser."""
    lex = lexicon(spark).select("parser", F.col("entity_class").alias("cls"), F.lower("syn").alias("key"), "idx", "case_sensitive", "syn")
    n = lex.groupBy("parser", "cls", "key").agg(F.count("*").alias("n_ids"))
    hit = ments.withColumn("key", F.lower("match")).join(F.broadcast(lex.join(n, ["parser", "cls", "key"])), "key")
    hit = hit.filter((F.col("entity_class") == F.col("cls")) & (~F.col("case_sensitive") | (F.col("match") == F.col("syn"))))
    return hit.select(
        "ent_id", "doc_id", "start", "end", "entity_class", "parser", "idx",
        F.lit("HIGHLY_LIKELY").alias("string_match_confidence"),
        F.when(F.col("n_ids") > 1, "AMBIGUOUS").otherwise(None).alias("disambiguation_confidence"),
    )


#: Adds maps(doc_id, s, e, entity_class, parser, idx, disamb) to MENTIONS.
MAPS = MENTIONS + """, ln AS (SELECT *, count(*) OVER (PARTITION BY parser, entity_class, lower(syn)) AS n_ids FROM lex),
maps AS (SELECT m.doc_id, m.s, m.e, m.entity_class, m.match, m.confidence, parser, idx, CASE WHEN n_ids > 1 THEN 'AMBIGUOUS' END AS disamb
  FROM mentions m JOIN ln ON lower(m.match) = lower(ln.syn) AND m.entity_class = ln.entity_class AND (NOT case_sensitive OR m.match = ln.syn))
"""


def cleanup_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_where(mapped(spark, mentions(spark, sf_dir)), P.low_confidence()).select("doc_id", "start", "end", "entity_class", "parser", "idx")


def cleanup_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    sure = P.drop_where(mapped(spark, m), P.low_confidence())
    return P.drop_unmapped(m, sure).select("doc_id", "start", "end", "entity_class", "match")


def cleanup_parser_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.createDataFrame([("function", "lex_b", 0), ("function", "lex_a", 1)], "entity_class string, parser string, rank int")
    return P.keep_best_parser(mapped(spark, mentions(spark, sf_dir)), ranks).select("doc_id", "start", "end", "entity_class", "parser", "idx")


def overlap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.islands(mentions(spark, sf_dir)).groupBy("doc_id", "section_idx", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")
    ).select("doc_id", "start", "end", "n")


_ISLANDS = """, o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, entity_class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mentions),
p AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, entity_class) AS island FROM o)
"""


def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    sure = P.drop_where(mapped(spark, m), P.low_confidence()).select("ent_id").distinct().withColumn("is_mapped", F.lit(True))
    ready = m.join(sure, "ent_id", "left").withColumn("is_mapped", F.coalesce("is_mapped", F.lit(False)))
    return P.merge_overlaps(ready, ("link", "gene", "function")).select("doc_id", "start", "end", "entity_class", "match")


_MERGE_SQL = MAPS + _ISLANDS + """, sure AS (SELECT DISTINCT doc_id, s, e, entity_class FROM maps WHERE disamb IS NULL),
w AS (SELECT p.*, row_number() OVER (PARTITION BY doc_id, island ORDER BY
    (EXISTS (SELECT 1 FROM sure x WHERE x.doc_id = p.doc_id AND x.s = p.s AND x.e = p.e AND x.entity_class = p.entity_class)) DESC, e - s DESC,
    CASE entity_class WHEN 'link' THEN 2 WHEN 'gene' THEN 1 ELSE 0 END DESC, confidence DESC, entity_class DESC) AS r FROM p)
SELECT doc_id, s AS start, e AS "end", entity_class, match FROM w WHERE r = 1
"""
_SPAN = 'doc_id, s AS start, e AS "end", entity_class'

CATALOGUE = {
    "dict_match": (dict_match, MENTIONS + f" SELECT {_SPAN}, match, confidence, candidates FROM mentions"),
    "dict_match_case_sensitive": (dict_match_case_sensitive, f'WITH {duck.tokens()} SELECT doc_id, s AS start, e AS "end", w AS match FROM tok WHERE w IN (\'The\', \'that\')'),
    "dict_match_confidence": (dict_match_confidence, MENTIONS + " SELECT doc_id, entity_class, max(confidence) AS best, count(*) AS n FROM mentions GROUP BY ALL"),
    "mention_counts_by_class": (
        mention_counts_by_class,
        MENTIONS + " SELECT entity_class, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs, max(confidence) AS max_confidence FROM mentions GROUP BY ALL",
    ),
    "cooccurrence_filter": (cooccurrence_filter, _COOC_SQL),
    "rule_filter": (rule_filter, _RULE_FILTER_SQL),
    "bio_spans_single": (bio_spans_single, _BIO_SQL),
    "bio_spans_multi": (bio_spans_multi, _MULTI_SQL),
    "split_numeric_list": (split_numeric_list, _SPLIT_SQL),
    "abbrev_candidates": (abbrev_candidates, _ABBREV_SQL),
    "abbrev_propagate": (abbrev_propagate, _PROPAGATE_SQL),
    "majority_vote": (
        majority_vote,
        f"WITH v AS (SELECT match, entity_class, count(*) AS votes FROM ({_EVENT_CLASSES}) GROUP BY ALL) "
        "SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY match ORDER BY votes DESC, entity_class) = 1",
    ),
    "max_score": (
        max_score,
        f"WITH v AS (SELECT match, entity_class, max(score) AS best FROM ({_EVENT_CLASSES}) GROUP BY ALL) "
        "SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY match ORDER BY best DESC, entity_class) = 1",
    ),
    "cleanup_min_len": (cleanup_min_len, MENTIONS + f" SELECT {_SPAN}, match FROM mentions WHERE length(match) >= 3"),
    "cleanup_class": (cleanup_class, MENTIONS + f" SELECT {_SPAN}, match FROM mentions WHERE entity_class IN ('gene', 'insult')"),
    "cleanup_stoplist": (
        cleanup_stoplist,
        MENTIONS + f" SELECT {_SPAN}, match FROM mentions WHERE (entity_class, lower(match)) NOT IN (('function', 'the'), ('gene', 'on'), ('link', 'and'))",
    ),
    "cleanup_mappings": (cleanup_mappings, MAPS + f" SELECT {_SPAN}, parser, idx FROM maps WHERE disamb IS NULL"),
    "cleanup_unmapped": (
        cleanup_unmapped,
        MAPS + f""" SELECT {_SPAN}, match FROM mentions m WHERE confidence >= 50 OR EXISTS (SELECT 1 FROM maps x
          WHERE x.doc_id = m.doc_id AND x.s = m.s AND x.e = m.e AND x.entity_class = m.entity_class AND disamb IS NULL)""",
    ),
    "cleanup_parser_rank": (
        cleanup_parser_rank,
        MAPS + f""", r AS (SELECT *, CASE WHEN entity_class = 'function' THEN CASE parser WHEN 'lex_b' THEN 0 ELSE 1 END ELSE 1073741824 END AS rank FROM maps)
        SELECT {_SPAN}, parser, idx FROM r QUALIFY rank = min(rank) OVER (PARTITION BY doc_id, s, e, entity_class)""",
    ),
    "overlap_islands": (overlap_islands, MENTIONS + _ISLANDS + ' SELECT doc_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM p GROUP BY doc_id, island'),
    "merge_overlaps": (merge_overlaps, _MERGE_SQL),
}
