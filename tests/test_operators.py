"""Operators on small fixtures."""

from pyspark.sql import functions as F

from glossa.operators import curation as C
from glossa.operators import evaluate as V
from glossa.operators import ner as M
from glossa.operators import post as P
from glossa.operators import strategies as T
from glossa.operators import synonyms as S
from glossa.operators import tokens as K


def sections(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, section_idx int, text string")


def dictionary(spark, *rows):
    return spark.createDataFrame(list(rows), "parser string, entity_class string, syn_norm string, text string, case_sensitive boolean, confidence int")


def spans(df):
    return sorted((r["section_idx"], r["start"], r["end"], r["entity_class"]) for r in df.collect())


def test_tokens_reproduce_the_text(spark):
    text = "α-β (x), it's  2nd.\n"
    rows = K.explode_tokens(K.section_tokens(sections(spark, text, None, ""))).collect()
    assert [r["token"] for r in rows] == ["α", "β", "x", "it", "s", "2nd"]
    assert all(text[r["start"] : r["end"]] == r["token"] for r in rows)


def test_sentences(spark):
    got = K.sentences(sections(spark, "One two. Three!  Four", "")).collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 8), (9, 15), (17, 21)]


def test_windows_and_stitching_undo_each_other(spark):
    df = spark.createDataFrame([(1, list(range(50))), (2, [7]), (3, list(range(10)))], "k int, items array<int>")
    back = K.stitch(K.windows(df, "items", 10, 4), ["k"], 4)
    assert {r["k"]: r["items"] for r in back.collect()} == {1: list(range(50)), 2: [7], 3: list(range(10))}


def test_dictionary_match_respects_case_and_boundaries(spark):
    d = dictionary(spark, ("p", "gene", "CAT", "CAT", True, 100), ("p", "animal", "CAT", "cat", False, 50), ("q", "animal", "CAT", "cat", False, 10))
    got = M.dictionary_match(sections(spark, "A CAT, a cat; concat"), d)
    assert spans(got) == [(0, 2, 5, "animal"), (0, 2, 5, "gene"), (0, 9, 12, "animal")]
    best = {r["entity_class"]: (r["confidence"], r["candidates"]) for r in got.filter("start = 2").collect()}
    assert best == {"animal": (50, ["p|CAT", "q|CAT"]), "gene": (100, ["p|CAT"])}


def test_dictionary_match_equals_a_scan(spark):
    import random

    rnd, words = random.Random(3), ["of", "the", "Of The", "a-b", "x"]
    text = " ".join(rnd.choice(["of", "the", "x", "a-b", "Of", "The", "(x)"]) for _ in range(200))
    got = M.dictionary_match(sections(spark, text), dictionary(spark, *(("p", "c", w.upper(), w, False, 1) for w in words)))
    import regex

    ends = [m.span() for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    starts, stops = {a for a, _ in ends}, {b for _, b in ends}
    low = text.lower()
    want = sorted({(0, i, i + len(w), "c") for w in words for i in range(len(low)) if low.startswith(w.lower(), i) and i in starts and i + len(w) in stops})
    assert spans(got) == want


def test_number_lists(spark):
    df = spark.createDataFrame([("BRCA1/2/3",), ("Monoclonal antibody D8/17",), ("a/b",)], "m string")
    got = [r["x"] for r in df.select(M.split_number_list(F.col("m")).alias("x")).collect()]
    assert got == [["BRCA1", "BRCA2", "BRCA3"], ["Monoclonal antibody D8", "Monoclonal antibody D17"], ["a/b"]]


def test_conjunctions(spark):
    df = spark.createDataFrame([("lung and breast cancer",), ("neither a nor b and c",)], "m string")
    got = [r["x"] for r in df.select(M.split_conjunction(F.col("m")).alias("x")).collect()]
    assert got == [["lung cancer", "breast cancer"], ["neither a nor b and c"]]


def test_abbreviations_take_over_the_long_form(spark):
    secs = sections(spark, "Acute Myeloid Leukaemia (AML) is a form of cancer. AML is treatable.", "AML is a serious disease")
    d = dictionary(spark, ("p", "disease", "AML", "Acute Myeloid Leukaemia", False, 50), ("p", "gene", "AML", "AML", False, 50))
    found = M.dictionary_match(secs, d)
    assert [tuple(r) for r in M.abbreviations(secs).collect()] == [(1, "AML", "Acute Myeloid Leukaemia")]
    after = M.propagate_abbreviations(found, secs)
    assert {r["entity_class"] for r in after.collect()} == {"disease"} and after.count() == 4
    kept = M.propagate_abbreviations(found, secs, exclude=("AML",))
    assert kept.filter("entity_class = 'gene'").count() == 3


def test_undefined_long_forms_remove_mentions(spark):
    secs = sections(spark, "Auto Mega Liquid (AML) is not a form of cancer")
    found = M.dictionary_match(secs, dictionary(spark, ("p", "gene", "AML", "AML", False, 50)))
    assert found.count() == 1 and M.propagate_abbreviations(found, secs).count() == 0


def test_label_spans(spark):
    rows = [(1, 0, 0, 0, 5, "B-x", ""), (1, 0, 1, 6, 8, "I-x", " "), (1, 0, 2, 9, 12, "B-x", " "), (1, 0, 3, 13, 15, "O", " "), (1, 0, 4, 17, 19, "I-x", " (")]
    words = spark.createDataFrame(rows, "doc_id long, section_idx int, pos int, start int, end int, label string, gap string")
    assert spans(M.label_spans(words)) == [(0, 0, 12, "x"), (0, 9, 12, "x"), (0, 17, 19, "x")]


def mention_rows(spark, rows):
    return spark.createDataFrame(
        [(1, 0, s, e, cls, conf, mapped, f"{s}-{e}-{cls}") for s, e, cls, conf, mapped in rows],
        "doc_id long, section_idx int, start int, end int, entity_class string, confidence int, is_mapped boolean, ent_id string",
    )


def test_merge_prefers_mapped_then_long_then_class(spark):
    m = mention_rows(spark, [(0, 8, "drug", 50, True), (0, 13, "drug", 50, False), (20, 25, "anatomy", 50, True), (20, 25, "drug", 50, True), (25, 28, "x", 1, False)])
    got = P.merge_overlaps(m, ("drug", "anatomy"))
    assert spans(got) == [(0, 0, 8, "drug"), (0, 20, 25, "drug"), (0, 25, 28, "x")]
    assert spans(P.merge_overlaps(got, ("drug", "anatomy"))) == spans(got)


def test_cleanup_keeps_nulls(spark):
    maps = spark.createDataFrame([("a", None, None), ("b", "HIGHLY_LIKELY", "AMBIGUOUS")], "ent_id string, string_match_confidence string, disambiguation_confidence string")
    assert [r["ent_id"] for r in P.drop_where(maps, P.low_confidence()).collect()] == ["a"]


def kb(spark):
    rows = [("1", "CDKN1B", s) for s in ("p27", "CDKN1B")] + [("2", "PAK2", s) for s in ("p27", "PAK2", "PAK-2p27")] + [("3", "ZNRD2", s) for s in ("p27", "Autoantigen p27")]
    return spark.createDataFrame([("g", "gene", i, lab, s, "x") for i, lab, s in rows], "parser string, entity_class string, idx string, default_label string, syn string, mapping_type string")


def test_candidates_of_an_ambiguous_symbol(spark):
    got = {r["syn_norm"]: (r["ids"], r["is_symbolic"]) for r in C.candidates(kb(spark)).collect()}
    assert got["P 27"] == (["1", "2", "3"], True)
    assert got["PAK 2"][0] == ["2"]


def test_similarity_groups_are_greedy_and_ordered(spark):
    cands = C.candidates(kb(spark).withColumn("default_label", F.when(F.col("idx") == "3", "CDKN1C").otherwise(F.col("default_label"))))
    labels = spark.createDataFrame([("g", "1", "CDKN1B"), ("g", "2", "PAK2"), ("g", "3", "CDKN1C")], "parser string, idx string, default_label string")
    got = {r["syn_norm"]: r["id_sets"] for r in C.group_by_similarity(cands, labels).collect()}
    assert got["P 27"] == [["1", "3"], ["2"]]


def test_case_conflicts(spark):
    rows = [("hello", True, 50), ("Hello", False, 50), ("ok", True, 100), ("OK", False, 50), ("two", False, 10), ("Two", False, 50)]
    s = spark.createDataFrame(rows, "text string, case_sensitive boolean, confidence int")
    assert sorted(r["low"] for r in C.case_conflicts(s).collect()) == ["hello", "two"]
    assert sorted(r["low"] for r in C.case_conflicts(s, strict=True).collect()) == ["hello", "ok", "two"]


def test_symbols_agree(spark):
    df = spark.createDataFrame([("IL 2", "2 IL"), ("AB", "A B"), ("AB C", "A B"), ("A A", "A")], "a string, b string")
    assert [r["v"] for r in df.select(T.symbols_agree(F.col("a"), F.col("b")).alias("v")).collect()] == [True, True, False, False]


def test_generators(spark):
    df = spark.createDataFrame([("r", "The cat sat in the mat"), ("s", "two words")], "resource_key string, text string")
    stop = {r["text"]: r["v"] for r in df.select("text", S.drop_stop_words(F.col("text")).alias("v")).collect()}
    assert stop == {"The cat sat in the mat": ["cat sat mat"], "two words": []}
    made = {r["text"] for r in S.generate(df, [S.hyphenate, S.drop_stop_words]).collect()}
    assert "two-words" in made and "cat sat mat" in made and not made & {"two words"}


def test_accuracy(spark):
    s = "id string, doc_id long, section_idx int, start int, end int, entity_class string"
    gold = spark.createDataFrame([("a", 1, 0, 0, 5, "x"), ("b", 1, 0, 10, 12, "x"), ("c", 1, 0, 20, 30, "y")], s)
    test = spark.createDataFrame([("d", 1, 0, 3, 8, "x"), ("e", 1, 0, 40, 44, "x"), ("f", 1, 0, 22, 25, "y")], s)
    got = {r["entity_class"]: (r["tp"], r["fp"], r["fn"]) for r in V.ner_accuracy(gold, test).collect()}
    # A gold span that strictly holds the test span doesn't agree with it.
    assert got == {"x": (1, 1, 1), "y": (0, 1, 1)}


def test_a_mention_outside_sentences_has_its_section(spark):
    from glossa.operators import ner as N

    secs = spark.createDataFrame([(1, 0, "na", "One. Two three.  ")], "doc_id long, section_idx int, name string, text string")
    ments = spark.createDataFrame([(1, 0, 0), (1, 0, 5), (1, 0, 9), (1, 0, 16), (2, 0, 0)], "doc_id long, section_idx int, start int")
    sents = spark.createDataFrame([(1, 0, 0, 0, 4), (1, 0, 1, 5, 15)], "doc_id long, section_idx int, sentence_idx int, start int, end int")
    got = sorted((r["start"], r["sentence"]) for r in N.sentence_context(ments, sents, secs).collect())
    assert got == [(0, "One."), (5, "Two three."), (9, "Two three."), (16, "One. Two three.  ")]
