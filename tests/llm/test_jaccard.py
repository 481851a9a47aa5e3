"""The n-gram Jaccard join against brute force."""

import re

from helpers import documents, near_copy, rng, words

from glossa.llm.jaccard import choose_bands, deduplicate, near_duplicates


def grams(text, n=2):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, threshold, n=2):
    """class_id and n_links by all pairs of distinct texts."""
    sets, copies = {}, {}
    for key, text in rows:
        w = tuple(re.findall(r"\w+", (text or "").lower()))
        if w:
            copies.setdefault(w, []).append(key)
    reps = {w: min(k) for w, k in copies.items()}
    for w, k in reps.items():
        sets[k] = grams(" ".join(w), n)
    links = {k: set() for k in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    root = {}
    for k in sorted(sets):
        todo = [k] if k not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k
                todo += links[x]
    out = {}
    for key, text in rows:
        w = tuple(re.findall(r"\w+", (text or "").lower()))
        out[key] = (root[reps[w]], len(links[reps[w]]), reps[w], len(copies[w])) if w else (key, 0, key, 1)
    return out


def corpus(seed, groups=12, size=6):
    rnd, rows = rng(seed), []
    for _ in range(groups):
        base = " ".join(words(rnd, 60, 5000))
        rows += [near_copy(rnd, base, rate) for rate in [0, 0, 0.02, 0.05, 0.05, 0.1][:size]]
    rows += [" ".join(words(rnd, 40, 5000)) for _ in range(40)] + ["", None, "!!!", "one", "One.", "two words", "two words"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"], r["n_copies"]) for r in df.collect()}


def test_bands_reach_the_recall():
    for t in (0.3, 0.55, 0.8):
        b, r = choose_bands(t, 0.95)
        assert 1 - (1 - t**r) ** b >= 0.95 and b * r <= 128


def test_equals_brute_force(spark):
    rows = corpus(1)
    got = result(near_duplicates(documents(spark, rows), threshold=0.5, recall=0.999, max_hashes=512))
    assert got == brute(rows, 0.5)


def test_crowded_buckets_are_cut_without_losing_links(spark):
    rnd = rng(4)
    base = " ".join(words(rnd, 80, 5000))
    rows = list(enumerate([near_copy(rnd, base, 0.01) for _ in range(60)]))
    got = result(near_duplicates(documents(spark, rows), threshold=0.5, recall=0.999, max_hashes=512, block=7))
    assert got == brute(rows, 0.5)


def test_ids_that_are_null_or_repeated_and_clashing_columns(spark):
    rows = [(1, "a b c d e"), (None, "a b c d e"), (1, "a b c d e"), (2, "x y z u v")]
    got = near_duplicates(documents(spark, rows).withColumnRenamed("lang", "node")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 2)]


def test_one_of_each_group_stays(spark):
    rows = corpus(2, groups=5) + [(0, "again here"), (0, "again here")]
    rows = [(k + 10, t) for k, t in rows[:-2]] + rows[-2:]
    docs = documents(spark, rows)
    kept = deduplicate(docs, threshold=0.5, recall=0.999, max_hashes=512)
    assert kept.columns == docs.columns
    want = brute(dict(rows).items(), 0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (c, *_) in want.items() if c == k)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert deduplicate(documents(spark, [])).count() == 0
