"""Vocabulary files as the long table (idx, default_label, syn, mapping_type), one reader per format."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = ["idx", "default_label", "syn", "mapping_type"]
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def _rows(df: DataFrame, syn, kind: str, *more) -> DataFrame:
    return df.select("idx", "default_label", syn.alias("syn"), F.lit(kind).alias("mapping_type"), *more)


def diseases_json(spark: SparkSession, path: str, areas: Sequence[str]) -> DataFrame:
    """JSON lines {id, name, therapeuticAreas, dbXRefs, synonyms{hasExactSynonym}} of the allowed areas."""
    schema = "id string, name string, therapeuticAreas array<string>, dbXRefs array<string>, synonyms struct<hasExactSynonym:array<string>>"
    raw = spark.read.schema(schema).json(path).filter(F.arrays_overlap("therapeuticAreas", F.array(*map(F.lit, areas))))
    base = raw.select(F.col("id").alias("idx"), F.col("name").alias("default_label"), "dbXRefs", F.col("synonyms.hasExactSynonym").alias("s"))
    return _rows(base, F.col("default_label"), "name", "dbXRefs").unionByName(
        _rows(base.withColumn("x", F.explode("s")), F.col("x"), "hasExactSynonym", "dbXRefs")
    )


TARGET_SCORED = ("subcellularLocations", "tractability", "constraint", "functionDescriptions", "go", "hallmarks", "chemicalProbes", "safetyLiabilities", "pathways", "targetClass")


def targets_json(spark: SparkSession, path: str, excluded: Sequence[str] = ()) -> DataFrame:
    """JSON lines of gene targets: symbols, names, synonyms and protein ids; annotation_score counts filled fields."""
    label = "array<struct<label:string,source:string>>"
    schema = (
        "id string, approvedSymbol string, approvedName string, biotype string, "
        f"synonyms {label}, obsoleteSymbols {label}, obsoleteNames {label}, proteinIds array<struct<id:string,source:string>>, "
        + ", ".join(f"{c} string" for c in TARGET_SCORED)
    )
    raw = spark.read.schema(schema).json(path).filter(~F.coalesce(F.col("biotype"), F.lit("")).isin(*excluded) & (F.col("id") != F.col("approvedSymbol")))
    filled = sum((F.coalesce(F.length(c), F.lit(0)) > 2).cast("int") for c in TARGET_SCORED)
    base = raw.withColumn("annotation_score", filled).withColumn("idx", F.col("id")).withColumn("default_label", F.col("approvedSymbol"))
    parts = [_rows(base, F.col(c), c, "annotation_score") for c in ("approvedSymbol", "approvedName", "id")]
    for c, f in (("synonyms", "label"), ("obsoleteSymbols", "label"), ("obsoleteNames", "label"), ("proteinIds", "id")):
        parts.append(_rows(base.withColumn("x", F.explode(c)), F.col(f"x.{f}"), c, "annotation_score"))
    return _union(parts)


def molecules_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, name string, synonyms array<string>, tradeNames array<string>, crossReferences map<string,array<string>>"
    raw = spark.read.schema(schema).json(path).select(F.col("id").alias("idx"), F.col("name").alias("default_label"), "synonyms", "tradeNames")
    names = F.array_distinct(F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), F.array("default_label")))
    return _union([_rows(raw.withColumn("x", F.explode(names)), F.col("x"), "synonyms"), _rows(raw.withColumn("x", F.explode("tradeNames")), F.col("x"), "tradeNames")])


def obo_graph_json(spark: SparkSession, path: str, iri: str = r"(MONDO|HP)_[0-9]+") -> DataFrame:
    """One JSON file {graphs[{nodes[{id, lbl, meta{synonyms[{pred, val}]}}]}]}: labels and exact synonyms."""
    schema = "graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<synonyms:array<struct<pred:string,val:string>>>>>>>"
    nodes = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode(F.col("graphs")[0]["nodes"]).alias("n"))
    base = nodes.filter(F.col("n.lbl").isNotNull() & F.col("n.id").rlike(iri)).select(F.col("n.id").alias("idx"), F.col("n.lbl").alias("default_label"), F.col("n.meta.synonyms").alias("s"))
    exact = base.withColumn("x", F.explode("s")).filter("x.pred = 'hasExactSynonym'")
    return _union([_rows(base, F.col("default_label"), "lbl"), _rows(exact, F.col("x.val"), "hasExactSynonym")])


GENE_KEYS = ("symbol", "name", "alias_symbol", "alias_name", "prev_symbol", "prev_name")


def genes_json(spark: SparkSession, path: str, keys: Sequence[str] = GENE_KEYS) -> DataFrame:
    """One JSON file {response{docs[{ensembl_gene_id, name, ...}]}}: each key's values, single or listed."""
    fields = ",".join(f"{k}:array<string>" for k in keys if k not in ("symbol", "name"))
    schema = f"response struct<docs:array<struct<ensembl_gene_id:string,symbol:string,name:string,{fields}>>>"
    docs = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("response.docs").alias("d"))
    base = docs.filter("d.ensembl_gene_id is not null and d.name is not null").select(F.col("d.ensembl_gene_id").alias("idx"), F.col("d.name").alias("default_label"), "d")
    parts = []
    for k in keys:
        values = F.array(F.col(f"d.{k}")) if k in ("symbol", "name") else F.col(f"d.{k}")
        parts.append(_rows(base.withColumn("x", F.explode(values)), F.col("x"), k))
    return _union(parts).filter("syn is not null").distinct()


def triples_xml(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of an RDF/XML file whose subjects carry rdf:about; small files, so read on the driver."""
    out = []
    for node in ET.parse(path).getroot():
        s = node.get(f"{RDF}about")
        if s is None:
            continue
        out.append((s, f"{RDF[1:-1]}type", node.tag.replace("{", "").replace("}", "")))
        for child in node:
            p = child.tag.replace("{", "").replace("}", "")
            out.append((s, p, child.get(f"{RDF}resource") or (child.text or "").strip()))
    return spark.createDataFrame(out, "s string, p string, o string")


@dataclass(frozen=True)
class RdfRule:
    """Which subjects of a triples table are terms, and the predicates of their labels and synonyms."""

    iri: str
    label: str
    synonyms: tuple[str, ...]
    include: tuple[tuple[str, str], ...] = ()
    exclude: tuple[tuple[str, str], ...] = ()
    drop_label: str | None = None


def rdf_terms(triples: DataFrame, rule: RdfRule) -> DataFrame:
    """Long table of the subjects whose IRI fits and that have all included and no excluded (p, o)."""
    subjects = triples.filter((F.col("p") == rule.label) & F.col("s").rlike(rule.iri)).select(F.col("s").alias("idx"), F.col("o").alias("default_label"))
    for pairs, how in ((rule.include, "left_semi"), (rule.exclude, "left_anti")):
        for p, o in pairs:
            subjects = subjects.join(triples.filter((F.col("p") == p) & (F.col("o") == o)).select(F.col("s").alias("idx")), "idx", how)
    if rule.drop_label:
        subjects = subjects.filter(~F.col("default_label").contains(rule.drop_label))
    syns = subjects.join(triples.filter(F.col("p").isin(*rule.synonyms)).select(F.col("s").alias("idx"), F.col("o").alias("x"), F.col("p").alias("k")), "idx")
    return _rows(subjects, F.col("default_label"), rule.label).unionByName(syns.select("idx", "default_label", F.col("x").alias("syn"), F.col("k").alias("mapping_type")))


def path_labels(triples: DataFrame, first: str, second: str) -> DataFrame:
    """(s, label) over two-step property paths s -first-> x -second-> label."""
    a = triples.filter(F.col("p") == first).select("s", F.col("o").alias("x"))
    return a.join(triples.filter(F.col("p") == second).select(F.col("s").alias("x"), F.col("o").alias("label")), "x").select("s", "label")


def stanzas_obo(spark: SparkSession, path: str) -> DataFrame:
    """[Term] stanzas with id and name; ``cell line`` is cut out of the names."""
    raw = spark.read.option("lineSep", "[Term]").text(path)
    got = raw.select(F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1).alias("idx"), F.trim(F.regexp_extract("value", r"(?m)^name:\s*(.+)$", 1)).alias("n")).filter("idx <> '' and n <> ''")
    name = F.trim(F.regexp_replace("n", "(?i)cell line", ""))
    return got.select("idx", name.alias("default_label"), name.alias("syn"), F.lit("name").alias("mapping_type"))


def hierarchy_asc(spark: SparkSession, hierarchy: str, low_terms: str, excluded: Sequence[str] = ()) -> DataFrame:
    """``$``-separated files: preferred terms with their low-level terms, and the two levels above."""
    h = spark.read.option("sep", "$").csv(hierarchy)
    cols = ["pt_code", "hlt_code", "hlgt_code", "soc_code", "pt_name", "hlt_name", "hlgt_name", "soc_name"]
    h = h.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(cols))).filter(~F.col("soc_name").isin(*excluded) if excluded else F.lit(True))
    low = spark.read.option("sep", "$").csv(low_terms).select(F.col("_c1").alias("llt_name"), F.col("_c2").alias("pt_code"))
    pt = h.join(low, "pt_code", "left").select(F.col("pt_code").alias("idx"), F.col("pt_name").alias("default_label"), F.coalesce("llt_name", "pt_name").alias("syn"), F.lit("link").alias("mapping_type"), "soc_name", "soc_code")
    up = [h.select(F.col(f"{k}_code").alias("idx"), F.col(f"{k}_name").alias("default_label"), F.col(f"{k}_name").alias("syn"), F.lit(k).alias("mapping_type"), "soc_name", "soc_code").distinct() for k in ("hlt", "hlgt")]
    return _union([pt, *up])


def families_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Family ID, Family name, Family alias, Common root gene symbol; a family with two names is an error."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    g = raw.groupBy(F.col("Family ID").alias("idx")).agg(
        F.collect_set("Family name").alias("names"), F.collect_set("Family alias").alias("aliases"), F.collect_set("Common root gene symbol").alias("roots")
    )
    g = g.filter(F.expr("assert_true(size(names) = 1, 'a family with several names') is null")).withColumn("default_label", F.col("names")[0])
    return _union([_rows(g.withColumn("x", F.explode(c)), F.col("x"), k) for c, k in (("names", "Family name"), ("aliases", "Family alias"), ("roots", "Common root gene symbol"))])


def delimited(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table that is in long form already."""
    return spark.read.options(**({"header": True} | options)).csv(path).select(*LONG)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def levels_txt(spark: SparkSession, path: str, skip: Sequence[str] = ("1", "2", "3")) -> DataFrame:
    """Lines ``code     Llabel`` (five spaces; L is the level): labels of the levels that aren't skipped."""
    parts = F.split("value", " {5,}")
    raw = spark.read.text(path).filter(F.size(parts) >= 2).select(F.trim(parts[0]).alias("idx"), F.trim(parts[1]).alias("r"))
    label = F.trim(F.substring("r", 2, 10_000))
    return raw.filter(~F.substring("r", 1, 1).isin(*skip)).select("idx", label.alias("default_label"), label.alias("syn"), F.lit("label").alias("mapping_type"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
