"""Apportionment and mixing: the highest quotients, targets, caps, whole texts."""

import re

from helpers import documents, rng, words
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm.mixing import mix, quotas, sainte_lague, sized, targets


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 80))
def test_quotients_equal_the_plain_procedure(parties, seats):
    votes, caps = [v for v, _ in parties], [c for _, c in parties]
    plain = [0] * len(votes)
    for _ in range(seats):
        best = max(((v / (2 * s + 1), -i) for i, (v, s, c) in enumerate(zip(votes, plain, caps)) if s < c and v > 0), default=None)
        if best is None:
            break
        plain[-best[1]] += 1
    assert sainte_lague(votes, seats, caps) == plain


def test_targets_fill_up_to_the_caps():
    assert targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert targets([10, 100, 1000], [1, 2, 3]) == [30, 300, 780]
    assert targets([0, 0], [1, 2]) == [0, 0]
    assert targets([], []) == []


def corpus(seed):
    rnd = rng(seed)
    rows = [(i, " ".join(words(rnd, rnd.choice([1, 20, 300]))), rnd.choice(["a", "b", "b", "c", None])) for i in range(300)]
    return rows + [(300, None, "a"), (301, "", "b"), (None, "w x", "c"), (5, "again", "c")]


def test_quotas(spark):
    docs = sized(documents(spark, corpus(3)))
    got = quotas(docs, shard_docs=50).collect()
    assert len(got) == docs.count()
    size, taken, target = {}, {}, {}
    for r in got:
        assert r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["mix_taken"] <= 3 * r["mix_size"]
        s = r["source"]
        size[s] = size.get(s, 0) + r["mix_size"]
        taken[s] = taken.get(s, 0) + r["mix_taken"]
        target[s] = r["mix_target"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([size[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])))
    assert target == want and all(r["mix_source_size"] == size[r["source"]] for r in got)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in names)
    again = {(r["doc_id"], r["text"]): r["mix_taken"] for r in quotas(docs, shard_docs=50).collect()}
    assert again == {(r["doc_id"], r["text"]): r["mix_taken"] for r in got}


def test_mixed_rows_hold_the_words_that_are_taken(spark):
    docs = documents(spark, corpus(4)).withColumnRenamed("lang", "passes")
    got = mix(docs, shard_docs=50)
    assert got.columns == docs.columns
    per = {}
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + len(r["text"].split())
    want = {}
    for r in quotas(sized(docs), shard_docs=50).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["mix_taken"]
    assert per == {k: v for k, v in want.items() if v}


def test_empty_and_wordless(spark):
    assert quotas(sized(documents(spark, []))).count() == 0
    assert mix(documents(spark, [(1, None), (2, " ")])).count() == 0
