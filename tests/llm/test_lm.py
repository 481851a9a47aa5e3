"""The base score by brute force, a proper distribution, gradients, and held-out gains."""

import math
import zlib
from collections import Counter

import numpy as np
from helpers import documents, rng, words

from glossa.llm import lm


def corpus(n=120, seed=1):
    rnd, rows = rng(seed), []
    for i in range(n):
        a, b = (("le", "la") if i % 3 else ("the", "of"))
        w = [x for v in words(rnd, 40, 60) for x in (v + a, rnd.choice([a, b]))]
        rows.append((i, " ".join(w) + f" rare{i} É\x1cx"))
    return rows


def brute(rows):
    texts = {k: (t or "").encode().lower().split() for k, t in rows}
    train = {k for k in texts if k is not None and zlib.crc32(str(k).encode()) % 10}
    c = Counter(w for k in train for w in texts[k])
    n = sum(c.values()) + len(train)
    z = n + 0.1 * (len(c) + bool(train) + 1)
    out = {}
    for k, w in texts.items():
        base = sum(math.log10((c[x] + 0.1) / z) for x in w) + math.log10((len(train) + 0.1) / z)
        out[k] = (k not in train, len(w) + 1, sum(c[x] > 0 for x in w) + bool(train), n, base)
    return out


def check(spark, rows, **options):
    got = {r["doc_id"]: r for r in lm.score(documents(spark, rows).withColumnRenamed("lang", "seq"), **options).collect()}
    for k, (held, n, known, total, base) in brute(rows).items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 and math.isfinite(r["score"]) and r["score"] < 0
    return got


def test_base_and_gain(spark):
    got = check(spark, corpus() + [(900, None), (901, ""), (None, "le la le")])
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 10]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_contexts_gain_over_the_same_model_without_them(spark):
    rows = corpus(200)
    total = lambda n: sum(r["score"] for r in lm.score(documents(spark, rows), head_count=3, rounds=n).collect() if r["held_out"])
    assert total(2) > total(0) + 50


def test_a_small_head_changes_no_base(spark):
    check(spark, corpus(40), head_share=0.02, head_count=1, rounds=1)


def test_without_training_rows(spark):
    check(spark, [(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3])
    assert lm.score(documents(spark, [])).count() == 0


def test_long_and_repeated_texts(spark):
    long = " ".join(words(rng(9), 150_000, 5000))
    got = lm.score(documents(spark, [(1, long), (2, "a b"), (2, "a b"), (3, long)])).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_tokens"], r["base_score"], r["score"]))
    assert len(got) == 4 and all(len(v) == 1 for v in by.values()) and next(iter(by[1]))[0] == 150_001


def test_tail_is_a_distribution():
    q, n = lm.tail_chances({1: 55, 2: 15, 17: 2}, {0: 60, 1: 20, 16: 30})
    assert abs(q.sum() - 1) < 1e-12 and q[0] > 0 and all(n[b] or q[b] == 0 for b in range(1, len(q)))
    assert lm.band(np.array([0, 1, 16, 17, 31, 32, 64])).tolist() == [0, 1, 16, 17, 17, 18, 19]


def small_model(spark, rows, rounds):
    docs = documents(spark, rows)
    counts = sorted(((r["c"], r["h"]) for r in lm.word_counts(docs).collect() if r["c"] >= 3), reverse=True)
    head, c = np.array([h for _, h in counts]), np.array([c for c, _ in counts])
    coded = lm.encode(docs, head).cache()
    model = lm.start_model(coded, c, len(rows), 50, 1000.0)
    for _ in range(rounds):
        model = lm.train_round(coded, model, lm.STEP)
    return model, c


def test_the_model_sums_to_one(spark):
    m, c = small_model(spark, corpus(60), 1)
    y, place = lm.with_ends(np.array([0, 5, m.size, 2, 1]), np.array([5]), m.size + 1)
    feats = lm.features(y, place, m.size + 2, m.rows)
    q, n = lm.tail_chances({1: 40, 2: 8}, {0: 30, 1: 20})
    band = 10 ** lm.tail_inner(q, n)
    assert abs(band[0] + (band[1:] * n[1:]).sum() - 1) < 1e-9
    for i in range(len(y)):
        total = 0.0
        for event in range(m.size + 2):
            p, v = lm.chances(m, [f[i : i + 1] for f in feats], m.group[[event]])
            total += p[0, m.group[event]] * v[0, m.level[event]] * 10 ** m.inner[event]
        assert abs(total - 1) < 1e-4
    assert m.groups > 3 and (m.level_bias > -1e8).sum() > m.groups


def test_gradient_steps_follow_the_loss():
    r = np.random.default_rng(0)
    size = 30
    group, level = np.arange(size + 2) % 3, np.arange(size + 2) // 3 % 4
    m = lm.Model(size, group, level, np.zeros(size + 2), np.zeros(size + 2), np.zeros(3, np.float32), np.zeros((3, 4), np.float32), np.zeros((4096, 3), np.float32), np.zeros((4096 * 3, 4), np.float32))
    s = r.integers(0, size, 4000)
    y, place = lm.with_ends((np.cumsum(s // 10) + 7 * np.arange(4000)) % size, np.full(40, 100), size + 1)
    y = np.where(place % 2 == 1, (np.roll(y, 1) * 7 + 3) % size, y)
    feats, own = lm.features(y, place, size + 2, m.rows), lm.Learner(m, 0.2)

    def loss():
        p, v = lm.chances(own.m, feats, group[y])
        at = np.arange(len(y))
        return -np.log(p[at, group[y]] * v[at, level[y]])[place % 2 == 1].mean()

    before = loss()
    for _ in range(60):
        own.learn(feats, y)
    assert loss() < 0.15 * before and own.seen.sum() == 60 * 5 * len(y) and not m.weights.any()


def test_features_see_only_what_comes_before():
    run = lambda s: np.stack(lm.features(*lm.with_ends(np.array(s), np.array([5, 5]), 98), 99, 4096))
    a, b = run([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), run([1, 2, 3, 5, 4, 6, 7, 8, 9, 10])
    assert (a[:, :4] == b[:, :4]).all() and (a[:, 4:6] != b[:, 4:6]).any() and (a[:, 6:] == b[:, 6:]).all()
    c = run([11, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    assert (a[:, 4] != c[:, 4]).any() and (a[:, 5] == c[:, 5]).all()


def test_every_round_takes_every_position(spark):
    m, _ = small_model(spark, corpus(30), 1)
    docs = documents(spark, corpus(30))
    head = np.array([h for _, h in sorted(((r["c"], r["h"]) for r in lm.word_counts(docs).collect() if r["c"] >= 3), reverse=True)])
    for r in lm.encode(docs, head).filter("train").collect():
        s = np.frombuffer(r["seq"], dtype="<u4").astype(np.int64)
        feats = lm.features(*lm.with_ends(s, np.array([len(s)]), m.size + 1), m.size + 2, m.rows)
        assert all((m.weights[f] != 0).any(axis=1).all() for f in feats)


def test_paths_lead_to_every_word_with_its_share():
    counts = np.array([900, 300, 300, 90, 80, *[9] * 40, 8])
    cls = np.array([0, 1, 1, 2, 2, *[2] * 41])
    nodes, branches, bias = lm.word_paths(counts, cls, 4)
    assert (nodes[0] == -1).all() and len({(k, *n, *b) for k, n, b in zip(cls.tolist(), nodes.tolist(), branches.tolist())}) == len(cls)
    for w, c in enumerate(counts):
        share = sum(bias[n, b] for n, b in zip(nodes[w], branches[w]) if n >= 0)
        own = cls == cls[w]
        assert abs(share - math.log((c + lm.SMOOTH) / (counts[own] + lm.SMOOTH).sum())) < 1e-4


def test_contexts_rank_the_words_of_a_class(spark):
    m, c = small_model(spark, corpus(60), 1)
    y, place = lm.with_ends(np.array([0, 5, m.size, 2, 1]), np.array([5]), m.size + 1)
    feats = lm.features(y, place, m.size + 2, m.rows)
    events = np.arange(m.size + 2)
    chance = np.stack([10 ** lm.log_chances(m, [np.repeat(f[i], len(events)) for f in feats], events) for i in range(len(y))])
    assert abs(chance.sum(axis=1) - 1).max() < 1e-4
    cls = m.group * lm.LEVELS + m.level
    wide = [k for k in np.unique(cls) if (cls == k).sum() > 1]
    within = [chance[:, cls == k] / chance[:, cls == k].sum(axis=1, keepdims=True) for k in wide]
    assert max(np.ptp(x, axis=0).max() for x in within) > 0.01
