"""The annotation job, its choice of steps, streams, and the driver entry."""

import subprocess
import sys
from pathlib import Path

import pytest

from glossa.operators.common import checkpointed
from glossa.plans.annotate import ConfigurationError, Pipeline, default_pipeline
from glossa.queries.fixtures import lexicon
from glossa.sources import documents as D
from glossa.streaming.stream import annotate_stream, document_stream, resume

ROOT = Path(__file__).resolve().parents[1]


def kb(spark):
    rows = [("p", "drug", "1", "Baclofen", "baclofen", "x"), ("p", "drug", "2", "Baclofen drug", "baclofen drug", "x"), ("p", "anatomy", "3", "Left lung", "left lung", "x")]
    return spark.createDataFrame(rows, "parser string, entity_class string, idx string, default_label string, syn string, mapping_type string")


def docs(spark):
    return spark.createDataFrame([(1, "Baclofen drug and the left lung."), (2, "no match"), (3, None), (4, "x" * 200_000)], "doc_id long, text string")


def test_job(spark):
    done = default_pipeline(kb(spark), cut=checkpointed)(docs(spark))
    got = sorted((r["doc_id"], r["match"], r["entity_class"]) for r in done.mentions.collect())
    assert got == [(1, "Baclofen drug", "drug"), (1, "left lung", "anatomy")]
    assert {r["idx"] for r in done.mappings.collect()} >= {"2", "3"}
    assert [(r["doc_id"], r["step"]) for f in done.failed for r in f.collect()] == [(4, "admission")]


def test_a_model_is_linked_in_the_vocabularies_of_its_class(spark):
    more = spark.createDataFrame([("q", "drug", "7", "Baclophen", "baclophen", "x"), ("r", "gene", "8", "Baclofene", "baclofene", "x")], kb(spark).schema)
    found = spark.createDataFrame([(1, 0, 4, 13, "Baclofene", "drug", "model", 100)], "doc_id long, section_idx int, start int, end int, match string, entity_class string, namespace string, confidence int")
    job = default_pipeline(kb(spark).unionByName(more), cut=checkpointed, model=lambda sections: found)
    assert list(job.steps) == ["dictionary", "model", "linking", "mapping", "abbreviations", "cleanup", "merge"]
    done = job(docs(spark), names=["model", "linking"])
    assert {(r["parser"], r["exact_match"]) for r in done.links.collect()} == {("p", False), ("q", False)}
    with pytest.raises(ConfigurationError):
        job.choose(["rules"])


def test_short_forms_take_over_mentions_and_mappings(spark):
    rows = [("p", "disease", "1", "Acute Myeloid Leukaemia", "acute myeloid leukaemia", "x"), ("p", "gene", "9", "AML", "aml", "x")]
    vocabulary = spark.createDataFrame(rows, kb(spark).schema)
    text = "Acute Myeloid Leukaemia (AML) is a form of cancer. AML is treatable."
    done = default_pipeline(vocabulary, cut=checkpointed)(spark.createDataFrame([(1, text), (2, "AML alone")], "doc_id long, text string"))
    got = sorted((r["doc_id"], r["start"], r["match"], r["entity_class"]) for r in done.mentions.collect())
    assert got == [(1, 0, "Acute Myeloid Leukaemia", "disease"), (1, 25, "AML", "disease"), (1, 51, "AML", "disease"), (2, 0, "AML", "gene")]
    by = {r["ent_id"]: r["idx"] for r in done.mappings.collect()}
    assert {(r["match"], by[r["ent_id"]]) for r in done.mentions.collect()} == {("Acute Myeloid Leukaemia", "1"), ("AML", "1"), ("AML", "9")}


def test_choice_of_steps():
    p = Pipeline({"a": lambda t: t, "b": lambda t: t}, {"g": ["b", "a"]})
    assert p.choose() == ["a", "b"] and p.choose(["b"]) == ["b"] and p.choose(group="g") == ["a", "b"]
    for bad in ({"names": ["c"]}, {"group": "h"}, {"names": ["a"], "group": "g"}):
        with pytest.raises(ConfigurationError):
            p.choose(**bad)


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    docs(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    job = default_pipeline(kb(spark))
    annotate = lambda d: job(d, group="ner_only").mentions.drop("candidates")
    stream = document_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 1)
    annotate_stream(stream, annotate, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = annotate(docs(spark))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert resume(docs(spark), got.select("doc_id")).count() == 3


def test_requests_and_tasks(spark):
    reqs = spark.createDataFrame([("a", '{"text": "one"}'), ("b", '{"sections": {"t": "x", "b": "y"}}')], "request_id string, body string")
    assert sorted(tuple(r) for r in D.web_requests(reqs).collect()) == [("a", 0, "na", "one"), ("b", 0, "t", "x"), ("b", 1, "b", "y")]
    secs = spark.createDataFrame([(1, 0, "na", "Baclofen drug")], "doc_id long, section_idx int, name string, text string")
    ments = spark.createDataFrame([(1, 0, 0, 8, "Baclofen", "drug", "d", 50)], "doc_id long, section_idx int, start int, end int, match string, entity_class string, namespace string, confidence int")
    back = D.read_tasks(D.annotation_tasks(secs, ments)).first()
    assert (back["text"], back["labels"], [tuple(s) for s in back["spans"]]) == ("Baclofen", ["drug"], [(0, 8)])
    assert '"match":"Baclofen"' in D.document_json(secs, ments).first()["json"]


def test_entry_imports_without_the_corpus_operators():
    code = (
        "import sys; sys.modules['glossa.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e;"
        "q = e.queries(); assert 'dict_match' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_lexicon_reads_alike(spark):
    assert lexicon(spark).count() == 21
