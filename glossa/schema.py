"""Schemas of the long tables, and the dataclass that carries an annotation job's tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

IGNORE, POSSIBLE, PROBABLE, HIGHLY_LIKELY = 0, 10, 50, 100
CONFIDENCE_NAMES = {IGNORE: "IGNORE", POSSIBLE: "POSSIBLE", PROBABLE: "PROBABLE", HIGHLY_LIKELY: "HIGHLY_LIKELY"}

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SECTION = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("sentence_spans", T.ArrayType(SPAN))]
)
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("sections", T.ArrayType(SECTION)),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: Long form of a vocabulary: one row per (identifier, synonym).
KB = "parser string, entity_class string, idx string, default_label string, syn string, mapping_type string"
MENTION = (
    "doc_id bigint, section_idx int, start int, end int, match string, entity_class string, namespace string,"
    " confidence int, candidates array<string>"
)
MAPPING = (
    "ent_id string, parser string, source string, idx string, default_label string, string_match_strategy string,"
    " string_match_confidence string, disambiguation_strategy string, disambiguation_confidence string"
)


@dataclass(frozen=True)
class KnowledgeBase:
    """kb (long table), candidates, candidate_ids, metadata and dictionary of one or several vocabularies."""

    kb: DataFrame
    candidates: DataFrame
    candidate_ids: DataFrame
    metadata: DataFrame
    dictionary: DataFrame


@dataclass(frozen=True)
class AnnotationTables:
    """What steps pass on: sections (doc_id, section_idx, text), mentions, candidates of mentions, mappings, failures."""

    sections: DataFrame
    mentions: DataFrame | None = None
    links: DataFrame | None = None
    mappings: DataFrame | None = None
    failed: tuple[DataFrame, ...] = field(default=())

    def but(self, **changes) -> AnnotationTables:
        return replace(self, **changes)
