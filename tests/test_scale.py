"""What grows with the input stays out of single rows, workers' objects, the driver and broadcasts."""

import random
import time
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.operators import curation as C
from glossa.operators import evaluate as V
from glossa.operators import ner as M
from glossa.operators import post as P
from glossa.operators import tokens as K
from glossa.operators.common import checkpointed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scan(make, batch):
    """What a scan's function does in a worker to one batch."""
    got = []
    caught = SimpleNamespace(mapInArrow=lambda run, schema: got.append(run))
    conf = SimpleNamespace(get=lambda *_: "1")
    make(SimpleNamespace(select=lambda *_: caught, sparkSession=SimpleNamespace(conf=conf)))
    return got[0](iter([batch]))


def test_token_scans_hold_a_slice_of_a_batch(spark):
    """A batch of ten thousand texts was a list of a dict for each token."""
    n = 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array(["word and word " * 20] * n)], names=["doc_id", "section_idx", "text"])
    tracemalloc.start()
    tokens = sum(len(b.column("tokens").flatten()) for b in scan(K.section_tokens, batch))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert tokens == 60 * n and most < 100


TEXTS = ["α-β (x), it's  2nd.\n", "", None, "...", "a", "𝔘nd ﬁ ½ b", "x" * 5, "  lead", "trail  ", "日本 語", "é é İ"]


def test_token_rows_and_ngrams_equal_a_scan_in_slices(spark, monkeypatch):
    import regex

    monkeypatch.setattr(K, "OUT_ROWS", 3)
    monkeypatch.setattr(K, "SLICE_BYTES", 16)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array([0] * len(TEXTS), pa.int32()), pa.array(TEXTS)], names=["doc_id", "section_idx", "text"])
    rows = [tuple(r.values()) for b in scan(K.token_rows, batch) for r in b.to_pylist()]
    grams = sorted(tuple(r.values()) for b in scan(lambda s: K.token_ngrams(s, 3), batch) for r in b.to_pylist())
    listed = {r["doc_id"]: [tuple(t.values()) for t in r["tokens"]] for b in scan(K.section_tokens, batch) for r in b.to_pylist()}
    other = [tuple(r.values()) for b in scan(lambda s: K.token_rows(s, r"\p{L}"), batch) for r in b.to_pylist()]
    want, runs, wide, single = [], [], {}, []
    for d, text in enumerate(t or "" for t in TEXTS):
        spans = [m.span() for m in regex.finditer(K.WORD, text)]
        want += [(d, 0, k, s, e, text[s:e], text[spans[k - 1][1] : s] if k else "") for k, (s, e) in enumerate(spans)]
        runs += [(d, 0, spans[i][0], spans[i + n - 1][1], n, text[spans[i][0] : spans[i + n - 1][1]]) for n in (1, 2, 3) for i in range(len(spans) - n + 1)]
        wide[d] = [(s, e, text[s:e], text[e:a]) for (s, e), a in zip(spans, [s for s, _ in spans[1:]] + [len(text)])]
        single += [(d, m.start(), m.end()) for m in regex.finditer(r"\p{L}", text)]
    assert rows == want and grams == sorted(runs) and listed == wide
    assert [(r[0], r[3], r[4]) for r in other] == single


def test_dictionary_mentions_are_not_shuffled(spark):
    secs = spark.createDataFrame([(1, 0, "The cat")], "doc_id long, section_idx int, text string")
    d = spark.createDataFrame([("p", "x", "CAT", "cat", False, 1), ("p", "x", "CAT", "CAT", True, 9)], "parser string, entity_class string, syn_norm string, text string, case_sensitive boolean, confidence int")
    found = M.dictionary_match(secs, d, 1)
    assert not any("start#" in line for line in plan(found).splitlines() if "Exchange hashpartitioning(" in line)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 4, 7, "cat", "x", "dictionary", 1, ["p|CAT"])]


def test_accuracy_sorts_mentions_instead_of_pairing_them(spark):
    """within a section and class every gold mention met every test mention, twice over."""
    rnd, cls = random.Random(5), ["x", "y", None]
    schema = "id string, doc_id long, section_idx int, start int, end int, entity_class string"
    spot = lambda: (rnd.randrange(3), 0, (s := rnd.randrange(60)), s + rnd.randrange(1, 9), rnd.choice(cls))
    gold, test = ([(f"{side}{i}", *spot()) for i in range(150)] for side in "gt")
    g, t = spark.createDataFrame(gold, schema), spark.createDataFrame(test, schema)
    pairs = V.span_pairs(g, t).collect()
    hits = {r["gold_id"] for r in pairs}, {r["test_id"] for r in pairs}
    acc = V.ner_accuracy(g, t)
    assert "Join" not in plan(acc)
    got = {r["entity_class"]: (r["tp"], r["fn"], r["fp"]) for r in acc.collect()}
    want = {}
    for c in cls:
        mine, theirs = [m[0] in hits[0] for m in gold if m[5] == c], [m[0] in hits[1] for m in test if m[5] == c]
        want[c] = (sum(mine), len(mine) - sum(mine), len(theirs) - sum(theirs))
    assert got == want and sum(w[0] for w in want.values()) > 20


def test_unmapped_mentions_are_found_in_one_join(spark):
    """mentions were read three times over."""
    m = spark.createDataFrame([("a", 10, "n"), ("b", 10, "n"), ("c", 50, "n"), ("d", None, "n"), ("e", 10, "o")], "ent_id string, confidence int, namespace string")
    maps = spark.createDataFrame([("a",), ("a",)], "ent_id string")
    got = P.drop_unmapped(m, maps, ["n"])
    assert plan(got).count("Join") == 1 and sorted(r["ent_id"] for r in got.collect()) == ["a", "c", "d", "e"]
    assert got.columns == m.columns and [r["ent_id"] for r in P.drop_unmapped(m, maps, below=None).collect()] == ["a"]


def test_the_cascade_reads_documents_once(spark, monkeypatch):
    """links and sets each scanned all documents."""
    from glossa.queries import linking

    plans = []
    monkeypatch.setattr(linking, "checkpointed", lambda df: plans.append(plan(df)) or checkpointed(df))
    linking.strategy_cascade(spark, "/root/testdata/sf0.001")
    assert sum("MapInArrow" in p for p in plans) == 1


def test_abbreviations_broadcast_nothing(spark, tmp_path):
    """F8: short forms, places and long forms grow with the documents but were sent to the driver."""
    secs = spark.createDataFrame([(1, 0, "Acute Myeloid Leukaemia (AML). AML")], "doc_id long, section_idx int, text string")
    found = spark.createDataFrame(
        [(1, 0, 0, 23, "Acute Myeloid Leukaemia", "disease", "d", 50, ["p|AML"])],
        "doc_id long, section_idx int, start int, end int, match string, entity_class string, namespace string, confidence int, candidates array<string>",
    )
    for df, name in ((secs, "secs"), (found, "found")):
        df.write.parquet(str(tmp_path / name))
    after = M.propagate_abbreviations(spark.read.parquet(str(tmp_path / "found")), spark.read.parquet(str(tmp_path / "secs")))
    assert "Broadcast" not in plan(after) and sorted(r["start"] for r in after.collect()) == [0, 25, 31]


def greedy(rows, threshold):
    """Ids (idx, label) in order into the set of the most similar label."""
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    sets = []
    for idx, label in sorted(rows):
        sims = [max(1 - lev(o, label) / max(len(o), len(label), 1) for _, o in s) for s in sets]
        if sims and max(sims) > threshold:
            sets[sims.index(max(sims))].append((idx, label))
        else:
            sets.append([(idx, label)])
    return [[i for i, _ in s] for s in sets]


@pytest.mark.parametrize("threshold", [0.4, 0.7, 1.0])
def test_similarity_groups_equal_the_plain_procedure(spark, threshold):
    rnd = random.Random(1)
    rows = [(str(i), "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 5)))) for i in range(60)] + [("7", "zz"), ("7", "aa")]
    cands = spark.createDataFrame([("p", "N", sorted({i for i, _ in rows}))], "parser string, syn_norm string, ids array<string>")
    labels = spark.createDataFrame([("p", *r) for r in rows], "parser string, idx string, default_label string")
    assert C.group_by_similarity(cands, labels, threshold).first()["id_sets"] == greedy(set(rows), threshold)


def test_similarity_groups_compare_labels_not_ids(spark):
    """every id was compared with all ids before it, several times."""
    n = 3000
    cands = spark.range(1).select(F.lit("p").alias("parser"), F.lit("N").alias("syn_norm"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")).alias("ids"))
    labels = spark.range(1, n + 1).select(F.lit("p").alias("parser"), F.col("id").cast("string").alias("idx"), F.concat(F.lit("some label "), F.col("id") % 3).alias("default_label"))
    began = time.time()
    sets = C.group_by_similarity(cands, labels, 0.99).first()["id_sets"]
    assert sorted(map(len, sets)) == [1000] * 3 and time.time() - began < 20


def test_nearest_in_sets_equals_all_pairs(spark, monkeypatch):
    """every pair of a label was a row, its cosine folded element by element."""
    from glossa.functions import text as X
    from glossa.operators import vectors as E

    rnd = random.Random(2)
    vectors = [[float(rnd.randrange(-2, 3)) for _ in range(3)] for _ in range(60)]
    vectors += [[0.0] * 3, None, [1.0, None, 2.0], [1.0, 2.0], [float("nan")] * 3, [5e-5, 1.0, 0.0], [5.01e-5, 1.0, 0.0]]
    e = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vectors)], "id long, v array<float>, label int")
    q = e.select(F.col("id").alias("key"), F.col("v").alias("q"), "label")
    c = e.select(F.col("id").alias("idx"), (F.col("id") % 5).alias("set_key"), F.col("v").alias("c"), "label")
    pairs = q.join(c, "label").filter("key <> idx").withColumn("similarity", F.round(X.cosine(F.col("q"), F.col("c")), 6))
    best = pairs.groupBy("key", "set_key").agg(F.max("similarity").alias("m"))
    want = pairs.join(best, ["key", "set_key"]).filter("similarity <=> m").select("key", "set_key", "idx", "similarity")
    for sizes in ((4, 7), (1 << 13, 1 << 16)):
        monkeypatch.setattr(E, "QUERY_BLOCK", sizes[0])
        monkeypatch.setattr(E, "CANDIDATE_BLOCK", sizes[1])
        got = E.nearest_in_sets(q, c, "label")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_definitions_are_sought_from_the_starts_of_words(spark):
    """from each character up to fourteen words were tried, each way of cutting them."""
    rnd = random.Random(4)
    words = ["a", "Bc", "(", ")", " ", " ", "\n", " ", "Acute Blood ", "(AB)", " (AB)", "Al Be (AB) ", "x" * 10]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["w " * n + "Al Be (AB) Al Be (AB)" for n in range(16)]
    secs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, section_idx int, text string")
    plain = F.regexp_extract_all("text", F.lit(r"((?:[^\s()]+\s+){1,14}\([^\s()]{2,9}\))"), F.lit(1))
    wrong = secs.filter(~plain.eqNullSafe(M.definitions(F.col("text"))))
    assert wrong.count() == 0 and secs.filter(F.size(M.definitions(F.col("text"))) > 0).count() > 500
    assert M.abbreviations(secs).filter("short = 'AB' and long = 'Al Be'").count() > 10
    long = spark.createDataFrame([(1, 0, "word " * 300_000)], "doc_id long, section_idx int, text string")
    assert M.abbreviations(long).count() == 0


def test_the_job_reads_documents_twice(spark, monkeypatch):
    """definitions and short forms were sought again for each later step, in all documents."""
    from glossa.plans.annotate import default_pipeline
    from glossa.queries.fixtures import lexicon, table

    plans = []
    cut = lambda df: plans.append(plan(df)) or checkpointed(df)
    job = default_pipeline(lexicon(spark).withColumn("mapping_type", F.lit("exact")), max_tokens=2, cut=cut)
    done = job(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"))
    plans += [plan(done.mentions), plan(done.mappings)]
    assert sum("FileScan" in p for p in plans) == 3 and sum("MapInArrow" in p for p in plans) == 2
