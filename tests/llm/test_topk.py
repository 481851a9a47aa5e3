"""Exact top-k against brute force, with ties, odd vectors and small blocks."""

import numpy as np
import pytest
from helpers import rng

from glossa.llm import topk
from glossa.llm.topk import ImpactIndex, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_index_is_exact():
    r = np.random.default_rng(1)
    rows = np.round(r.normal(0, 8, (3000, 16))).astype(np.int64)
    rows[100:160] = rows[100]
    ids = r.permutation(3000)
    index, queries = ImpactIndex(ids, rows), rows[::37]
    for got, q, own in zip(index.search(queries, ids[::37].tolist(), 9), queries, ids[::37]):
        s = rows @ q
        m = ids != own
        o = np.lexsort((ids[m], -s[m]))[:9]
        assert got == list(zip(s[m][o].tolist(), ids[m][o].tolist()))


@pytest.mark.parametrize("n", [3, 500, 5000])
def test_segments_are_visited_at_every_size(n):
    r = np.random.default_rng(n)
    rows = np.floor(64 * r.normal(0, 0.3, (n, 64))).astype(np.int64)
    ids = np.arange(n)
    index, queries = ImpactIndex(ids, rows), rows[::20]
    got = index.search(queries, ids[::20].tolist(), 20)
    assert index.visits >= len(queries) and sum(len(p) for seg in index.segments for _, p, _ in seg) == (rows != 0).sum()
    for hits, q, own in zip(got, queries, ids[::20]):
        s = rows @ q
        m = ids != own
        o = np.lexsort((ids[m], -s[m]))[:20]
        assert hits == list(zip(s[m][o].tolist(), ids[m][o].tolist()))


def test_a_proof_ends_a_search_early():
    r = np.random.default_rng(1)
    rows = np.floor(r.normal(0, 1, (4000, 32)) * 2.0 ** -np.arange(32) * 4096).astype(np.int64)
    index = ImpactIndex(np.arange(4000), rows)
    index.search(rows[:200], [None] * 200, 5)
    assert 200 <= index.visits < 200 * len(index.segments)


def test_large_components_are_exact_or_refused():
    rows = np.array([[2**40, 3], [2**40, 2], [-(2**40), 5], [1, 1]], dtype=np.int64)
    index = ImpactIndex(np.arange(4), rows)
    assert index.search(np.array([[2**20, 1]]), [None], 2) == [[(2**60 + 3, 0), (2**60 + 2, 1)]]
    with pytest.raises(OverflowError):
        index.search(np.array([[2**40, 1]]), [None], 2)


def brute(rows, k):
    ok = {(i, tuple(int(np.floor(64.0 * x)) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    out = set()
    for i in {i for i, _ in ok if i % 20 == 0}:
        hits = [(-sum(a * b for a, b in zip(v, w)), j) for own, v in ok if own == i for j, w in ok if j != i]
        out |= {(i, n, j, -s) for n, (s, j) in enumerate(sorted(hits)[:k], 1)}
    return out


def test_table(spark):
    rnd = rng(2)
    rows = [(i, [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(8)]) for i in range(200)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")] * 8), (260, []), (None, [1.0] * 8), (3, rows[3][1]), (280, [0.5] * 8), (281, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnRenamed("label", "score")
    for block in (16_384, 30):
        got = top_k(df, df.filter("vec_id % 20 = 0"), 5, block=block, query_block=4)
        assert {tuple(r) for r in got.collect()} == brute(rows, 5)
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, empty).count() == 0
    few = spark.createDataFrame([(20, [1.0], 0), (21, [0.5], 0)], SCHEMA)
    assert [tuple(r) for r in top_k(few, few.filter("vec_id = 20")).collect()] == [(20, 1, 21, 2048)]


def test_floors_end_searches_and_keep_ties():
    r = np.random.default_rng(4)
    rows = np.floor(64 * r.normal(0, 0.125, (6000, 64))).astype(np.int64)
    rows[50:80] = rows[50]
    index, queries = ImpactIndex(np.arange(6000), rows), rows[:200]
    want = index.search(queries, list(range(200)), 20)
    free = index.visits
    got = index.search(queries, list(range(200)), 20, np.array([w[9][0] for w in want]))
    assert index.visits - free <= free
    for hits, w in zip(got, want):
        assert [h for h in hits if h[0] >= w[9][0]] == [h for h in w if h[0] >= w[9][0]]


def test_a_sample_bounds_what_cells_return(spark, monkeypatch):
    r, sent, cells = np.random.default_rng(5), [], topk._cells
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 0.125, 16))]) for i in range(3000)] + [(20, [0.5] * 16)]
    monkeypatch.setattr(topk, "_cells", lambda *a: sent.append(cells(*a)) or sent[-1])
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = top_k(df, df.filter("vec_id % 100 = 20"), 3, block=100)
    want = {t for t in brute([(i, v) for i, v in rows], 3) if t[0] % 100 == 20}
    assert {tuple(x) for x in got.collect()} == want
    first, rest = (x.count() for x in sent)
    assert first > 0 and rest < 31 * 30 * 3
