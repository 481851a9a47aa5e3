"""Fingerprints, the next document, and all pairs within a radius, against brute force."""

import hashlib

from helpers import documents, random_text, rng, words

from glossa.llm.simhash import Fingerprinter, block_masks, edited, fingerprints, likeness, near_fingerprints, op10_simhash


def test_masks_meet_within_the_radius():
    rnd, masks = rng(0), block_masks(3, 6)
    assert len(masks) == 20
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_texts_and_their_successors(spark):
    rnd = rng(1)
    rows = [(i * 3 - 20, " ".join(words(rnd, rnd.choice([0, 1, 30, 200])))) for i in range(60)] + [(500, None), (501, ""), (502, "?!"), (503, random_text(rnd, 300))]
    got = {r["doc_id"]: r for r in fingerprints(documents(spark, rows).withColumnRenamed("lang", "bucket"), partitions=7).collect()}
    f, ordered = Fingerprinter(), sorted((k, t or "") for k, t in rows)
    assert len(got) == len(rows)
    for (k, t), (_, nxt) in zip(ordered, [*ordered[1:], ordered[0]]):
        r, e = got[k], edited(t, nxt)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == f"{f.of(t):016x}" and r["edited_fingerprint"] == f"{f.of(e):016x}"
        assert r["near_edited"] == likeness(f.of(t), f.of(e)) and r["near_next"] == likeness(f.of(t), f.of(nxt))


def test_edits_stay_nearer_than_strangers(spark):
    rnd = rng(2)
    got = fingerprints(documents(spark, [(i, " ".join(words(rnd, 200, 5000))) for i in range(40)])).collect()
    assert sum(r["near_edited"] for r in got) / 40 > sum(r["near_next"] for r in got) / 40 + 0.15


def test_odd_tables(spark):
    assert fingerprints(documents(spark, [])).count() == 0
    one = fingerprints(documents(spark, [(1, "alone here now")])).first()
    assert one["near_next"] == 1.0
    rows = [(None, "x y"), (None, "z"), (4, "same"), (4, "same"), (5, "t")]
    assert fingerprints(documents(spark, rows)).count() == 5


def test_all_neighbours(spark):
    rnd, values = rng(3), []
    for _ in range(15):
        a = rnd.getrandbits(64)
        values += [a, a]
        for flips in (1, 2, 3, 4, 6):
            b = a
            for bit in rnd.sample(range(64), flips):
                b ^= 1 << bit
            values.append(b)
    table = spark.createDataFrame([(f"{v:016x}",) for v in values] + [(None,)], "fingerprint string")
    want = {f"{v:016x}": (values.count(v), sum(w != v and (v ^ w).bit_count() <= 3 for w in set(values))) for v in values}
    for block in (1024, 2):
        got = {r["fingerprint"]: (r["n_docs"], r["n_near"]) for r in near_fingerprints(table, block=block).collect()}
        assert got == want


def test_no_side_of_the_search_is_broadcast(spark):
    rnd = rng(5)
    table = spark.createDataFrame([(f"{rnd.getrandbits(64):016x}",) for _ in range(50)], "fingerprint string")
    near = near_fingerprints(table)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_query_finds_near_fingerprints(spark, tmp_path):
    rnd = rng(4)
    long = words(rnd, 3000, 2000)
    rows = [(i, " ".join(words(rnd, 50, 2000))) for i in range(30)] + [(100, " ".join(long)), (101, " ".join([*long, "more"])), (102, "same text"), (103, "same text"), (104, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op10_simhash(spark, str(tmp_path)).collect()}
    prints = {k: int(r["fingerprint"], 16) for k, r in got.items()}
    assert len(got) == len(rows)
    for k, r in got.items():
        near = {v for v in prints.values() if v != prints[k] and (v ^ prints[k]).bit_count() <= 3}
        assert (r["n_docs"], r["n_near"]) == (list(prints.values()).count(prints[k]), len(near))
    assert got[102]["n_docs"] == 2 and got[100]["n_near"] + got[100]["n_docs"] > 1
