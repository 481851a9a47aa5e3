"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from glossa.functions import normalize as N
from glossa.functions import text as X

GOLDEN = [
    ("MOP-2", "gene", "MOP 2"),
    ("y(+)L-type amino acid transporter 1", None, "Y (+) L TYPE AMINO ACID TRANSPORTER 1"),
    ("mTOR", "gene", "MTOR"),
    ("erbB2", "gene", "ERBB 2"),
    ("egfr(-)", "gene", "EGFR (-)"),
    ("C0D0C4J1X3", None, "C0D0C4J1X3"),
    ("JAK2", "gene", "JAK 2"),
    ("MPNs", "gene", "MPN"),
    ("TESTIN gene", "gene", "TESTIN GENE"),
    ("Chromosome X", None, "CHROMOSOME X"),
    ("complexVII diseaseα", "disease", "COMPLEX 7 DISEASE ALPHA"),
    ("Acme corp", "company", "ACME CORP"),
]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,cls,expected", GOLDEN)
def test_normalize(spark, text, cls, expected):
    assert one(spark, text, lambda c: N.normalize(c, cls)) == expected


def test_normalising_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(t,) for t, *_ in GOLDEN], "c string").select(N.normalize_phrase(F.col("c")).alias("a"))
    again = rows.select("a", N.collapse(F.upper(N.remove_marks(F.col("a")))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in again)


@pytest.mark.parametrize("word,single", [("mosquitoes", "mosquito"), ("antibodies", "antibody"), ("switches", "switch"), ("apoptosis", "apoptosis"), ("MAPKs", "MAPK"), ("gas", "gas"), ("receptors", "receptor")])
def test_depluralize(spark, word, single):
    assert one(spark, word, N.depluralize) == single


def test_null_stays_null(spark):
    assert one(spark, None, N.normalize) is None


def test_ngrams(spark):
    assert one(spark, "abc", X.char_ngrams) == ["ab", "bc"]
    assert one(spark, "a", X.char_ngrams) == []
    assert one(spark, "a b c", X.word_ngrams) == ["a b", "b c"]
    assert one(spark, "ab c", X.context_grams) == ["ab", "c", "ab c", "ab", "b ", " c", "ab ", "b c"]


def test_identifiers(spark):
    assert one(spark, "http://a.org/x/y_1?q#f", X.strip_uri) == "y_1"
    assert one(spark, "plain/1", X.strip_uri) == "plain/1"
    assert one(spark, "MONDO_1", X.id_source) == "MONDO"
    row = spark.createDataFrame([("UMLS:C1",)], "c string").select(*X.curie_parts(F.col("c"), {"UMLS": "umls"})).first()
    assert tuple(row) == ("umls", "C1")


@pytest.mark.parametrize("a,b,ok", [("IL 2", "IL 2 GENE", True), ("IL 2", "IL 3", False), ("1 2", "2 1", True), ("", "X", True)])
def test_numbers_match(spark, a, b, ok):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(X.numbers_match(F.col("a"), F.col("b")).alias("v")).first()["v"] is ok


@pytest.mark.parametrize("a,b,ok", [("DIABETES", "DIABETES TYPE 1", True), ("DIABETES TYPE 1", "DIABETES", False), ("TYPE I", "TYPE I TYPE I", True)])
def test_subtypes_match(spark, a, b, ok):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(X.subtypes_match(F.col("a"), F.col("b")).alias("v")).first()["v"] is ok
