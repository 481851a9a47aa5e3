"""Nearest examples by brute force, calibration, and held-out accuracy."""

import math
import zlib
from collections import Counter

from helpers import documents, rng, words

from glossa.llm.toxicity import BlockMaxIndex, association, fit, isotonic, reject_toxic, score

import numpy as np

BAD = ["scum", "idiot", "moronic", "trashy"]


def corpus(n=600, seed=1):
    rnd, rows, labels = rng(seed), [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        w = words(rnd, 30, 300)
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(30)] = rnd.choice(BAD) + rnd.choice(["", "s", "ly"])
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_search_is_exact():
    rnd = rng(1)

    def vec():
        v = {t: rnd.random() for t in rnd.sample(range(40), rnd.randrange(1, 8))}
        n = sum(x * x for x in v.values()) ** 0.5
        return {t: x / n for t, x in v.items()}

    vectors, keys = [vec() for _ in range(400)] + [{3: 1.0}] * 20, list(range(1000, 1420))
    rnd.shuffle(keys)
    flat = [(t, w) for v in vectors for t, w in sorted(v.items())]
    hashes = np.arange(420, dtype=np.uint64) // 2
    index = BlockMaxIndex.build(
        np.array(keys), hashes, np.array([len(v) for v in vectors]), np.array([t for t, _ in flat]), np.array([w for _, w in flat]), 40, block=16
    )
    queries = [sorted(vec().items()) for _ in range(50)] + [[]]
    none = np.uint64(999)
    own = np.array([none if i % 2 else np.uint64(i) for i in range(51)])
    flat = [x for q in queries for x in q]
    per = np.array([len(q) for q in queries])
    found = index.search(np.array([t for t, _ in flat]), np.array([w for _, w in flat]), per, 10, own, step=1)
    for q, mine, (near, at) in zip(queries, own, found):
        scored = [(-round(sum(w * v.get(t, 0) for t, w in q), 12), k) for k, v, h in zip(keys, vectors, hashes) if h != mine]
        want = sorted(x for x in scored if x[0] < 0)[:10]
        assert np.allclose(near, [-c for c, _ in want], atol=1e-9) and index.keys[at].tolist() == [k for _, k in want]


def test_neighbours_equal_brute_force_over_all_words(spark):
    rows, labels = corpus(150)
    model = fit(documents(spark, rows), label_table(spark, labels))
    texts = dict(rows)
    df = Counter(w for t in texts.values() for w in set(t.split()))
    sample = sorted(int(k) for k in model.index.keys)
    assert set(sample) == {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    known = sorted({w for k in sample for w in texts[k].split()})
    assert len(model.words) == len(known)
    toxic = {i: t for i, _, t in labels}
    n1, n0 = (Counter(w for k in sample if toxic[k] == y for w in set(texts[k].split())) for y in (1, 0))
    all1 = sum(toxic[k] for k in sample)
    factor = association(np.array([n1[w] for w in known], float), np.array([n0[w] for w in known], float), all1, len(sample) - all1)
    assert (factor > 0).all()
    weight = {w: (math.log((1 + len(rows)) / (1 + df[w])) + 1) * f for w, f in zip(known, factor)}

    def vector(text):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in Counter(text.split()).items() if w in weight}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    vectors = {k: vector(texts[k]) for k in sample}
    for r in score(documents(spark, rows), model).collect():
        q = vector(r["text"])
        want = sorted((-round(sum(x * vectors[k].get(w, 0) for w, x in q.items()), 6), k) for k in sample if texts[k] != r["text"])[:5]
        cos = lambda k: sum(x * vectors[k].get(w, 0) for w, x in q.items())
        assert np.allclose([cos(k) for k in r["tox_evidence"]], [-c for c, _ in want], atol=2e-6) and r["doc_id"] not in r["tox_evidence"]


def test_equal_texts_score_alike_whatever_their_labels(spark):
    rows, labels = corpus(200)
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    labels += [(1000 + i, 0, 1 - labels[i][2]) for i in range(40)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["tox_score"] for r in score(docs, fit(docs, label_table(spark, labels))).collect()}
    assert all(got[i] == got[1000 + i] for i in range(40))


def test_clashing_names(spark):
    rows, labels = corpus(100)
    docs = documents(spark, rows).withColumnRenamed("lang", "tox_score").withColumnRenamed("source", "Tox_Evidence_")
    kept = reject_toxic(docs, label_table(spark, labels))
    assert kept.columns == docs.columns and 50 < kept.count() < 100


def test_isotonic_rises():
    x, p = isotonic(np.array([0.1, 0.5, 0.4, 0.9]), np.array([0, 0, 1, 1.0]), np.ones(4), 0.3)
    assert x == sorted(x) and p == sorted(p) and 0 <= p[0] and p[-1] <= 1


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    truth = {i: t for i, _, t in labels}
    got = {r["doc_id"]: r["tox_score"] for r in score(docs, fit(docs, label_table(spark, labels))).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == bool(truth[i]) for i in held)
    assert len(held) > 50 and right / len(held) > 0.95


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (score(docs, fit(docs, label_table(spark, x))).select("doc_id", "tox_score").collect() for x in (labels, flipped))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows(spark):
    rows, labels = corpus(200)
    rows += [(900, None), (901, ""), (None, "scum idiot"), (902, "scum " * 5000), (3, rows[3][1])]
    labels += [(900, 1, 0), (None, 1, 1), (5, None, None), (3, 0, 1)]
    docs = documents(spark, rows).withColumnRenamed("lang", "label")
    out = score(docs, fit(docs, label_table(spark, labels)))
    assert out.columns == [*docs.columns, "tox_score", "tox_evidence"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["tox_score"] <= 1 for r in got)
    long = next(r for r in got if r["doc_id"] == 902)
    assert long["tox_score"] > 0.5 and long["tox_evidence"]


def test_without_labels_or_rows(spark):
    none = label_table(spark, [])
    docs = documents(spark, [(1, "a"), (2, None)])
    assert {r["tox_score"] for r in score(docs, fit(docs, none)).collect()} == {0.5}
    assert score(documents(spark, []), fit(documents(spark, []), none)).count() == 0
    assert reject_toxic(documents(spark, []), none).count() == 0
