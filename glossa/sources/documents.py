"""Documents in and out: nested tables, JSON, web requests, annotation tasks, failure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOCUMENT


def nested_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, sections[{section, text, subSection}]) as sections; of equal ids the one with most sections stays."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc(F.size("sections")), F.xxhash64("sections"))
    docs = spark.read.parquet(path).select("id", "sections").withColumn("r", F.row_number().over(w)).filter("r = 1")
    return docs.select(F.col("id").alias("doc_id"), F.posexplode("sections").alias("section_idx", "s")).select(
        "doc_id", "section_idx", F.concat_ws(" / ", "s.section", "s.subSection").alias("name"), F.col("s.text").alias("text")
    )


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per line; lines that don't parse are left out."""
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)


def web_requests(requests: DataFrame, column: str = "body") -> DataFrame:
    """request_id, section_idx, name, text of ``{text}`` or ``{sections: {name: text}}`` bodies."""
    one = F.from_json(column, "text string, sections map<string,string>")
    body = requests.select("request_id", one.alias("b"))
    entries = F.when(F.col("b.sections").isNotNull(), F.map_entries("b.sections")).otherwise(
        F.array(F.struct(F.lit("na").alias("key"), F.col("b.text").alias("value")))
    )
    return body.select("request_id", F.posexplode(entries).alias("section_idx", "e")).select(
        "request_id", "section_idx", F.col("e.key").alias("name"), F.col("e.value").alias("text")
    )


def whole_section_mentions(sections: DataFrame, entity_class: str) -> DataFrame:
    """Each section as one mention, for linking alone."""
    return sections.select(
        "doc_id", "section_idx", F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("match"), F.lit(entity_class).alias("entity_class")
    )


def document_json(sections: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, json: nested documents, fields without value left out."""
    m = mentions.groupBy("doc_id", "section_idx").agg(F.sort_array(F.collect_list(F.struct("start", "end", "match", "entity_class", "namespace", "confidence"))).alias("entities"))
    s = sections.join(m, ["doc_id", "section_idx"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_idx", "name", "text", "entities"))).alias("sections"))
    return s.select("doc_id", F.to_json(F.struct("doc_id", "sections"), {"ignoreNullFields": "true"}).alias("json"))


def brat_lines(mentions: DataFrame) -> DataFrame:
    """doc_id, line: tab-separated mentions."""
    return mentions.select("doc_id", F.concat_ws("\t", "match", "entity_class", F.col("start").cast("string"), F.col("end").cast("string")).alias("line"))


def annotation_tasks(sections: DataFrame, mentions: DataFrame) -> DataFrame:
    """task_id, json: a task per section with one label region per mention."""
    region = F.struct(
        F.concat_ws("_", "start", "end", "entity_class").alias("id"), F.lit("ner").alias("from_name"),
        F.struct("start", "end", F.col("match").alias("text"), F.array("entity_class").alias("labels")).alias("value"),
    )
    m = mentions.groupBy("doc_id", "section_idx").agg(F.sort_array(F.collect_list(region)).alias("result"))
    return sections.join(m, ["doc_id", "section_idx"], "left").select(
        F.concat_ws("_", "doc_id", "section_idx").alias("task_id"), F.to_json(F.struct(F.struct("text").alias("data"), "result")).alias("json")
    )


def read_tasks(tasks: DataFrame) -> DataFrame:
    """task_id, spans, labels, text of exported tasks: relations join two regions into one split mention."""
    region = "struct<id:string,type:string,from_id:string,to_id:string,value:struct<start:int,end:int,text:string,labels:array<string>>>"
    r = tasks.select("task_id", F.explode(F.from_json("json", f"result array<{region}>")["result"]).alias("r"))
    regions = r.filter("r.value is not null").select("task_id", F.col("r.id").alias("id"), "r.value.*")
    rel = r.filter("r.type = 'relation'").select("task_id", "r.from_id", "r.to_id")
    a, b = (regions.select("task_id", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "start", "end", "text", "labels"))) for p in "ab")
    pairs = rel.join(a, ["task_id"]).filter("a_id = from_id").join(b, ["task_id"]).filter("b_id = to_id")
    joined = pairs.select(
        "task_id",
        F.array(F.struct(F.col("a_start").alias("start"), F.col("a_end").alias("end")), F.struct(F.col("b_start").alias("start"), F.col("b_end").alias("end"))).alias("spans"),
        F.array_intersect("a_labels", "b_labels").alias("labels"),
        F.concat_ws(" ", "a_text", "b_text").alias("text"),
    )
    used = rel.select("task_id", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    alone = regions.join(used, ["task_id", "id"], "left_anti").select("task_id", F.array(F.struct("start", "end")).alias("spans"), "labels", "text")
    return joined.unionByName(alone)


def write_resources(resources: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Curated strings as JSON lines, shortest first, so many per file."""
    resources.orderBy(F.length("text"), "text").write.mode("overwrite").option("maxRecordsPerFile", per_file).json(path)


def write_failed(failed: DataFrame, path: str) -> None:
    """Failed documents (step, doc_id, error) in a folder per step."""
    failed.write.mode("overwrite").partitionBy("step").json(path)
