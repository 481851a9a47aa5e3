"""Rules by brute force; boosted trees by held-out accuracy."""

import numpy as np
from helpers import rng

from glossa.llm.urls import OP2_RULES, BoostedTrees, Rules, UrlModel, best_threshold, judge, split_url


def test_split():
    assert split_url("http://A.Example.COM/En/X?q=/#f") == ("a.example.com", "/En/X")
    assert split_url("ftp://h#x/y") == ("h", "") and split_url("h/x") == ("", "") and split_url(None) == ("", "") and split_url("a://É.com") == ("É.com", "")


def test_rules():
    m = OP2_RULES.match
    assert m("a.example.com", "/en/1") == ("example.com/en/", "block")
    assert m("x.www.example.com", "/en/") == ("www.example.com/en/", "allow")
    assert m("notexample.com", "/en/") == ("com/", "allow") and m("com", "/") == ("com/", "allow") and m("a.com", "") is None
    assert m("x.net", "/fr/1") == ("net/fr/", "block") and m("x.net", "/frx") is None and m("xcom", "/") is None


def urls(n, seed):
    rnd, out = rng(seed), []
    for _ in range(n):
        bad = rnd.random() < 0.4
        host = f"{rnd.choice(['win', 'bet', 'free'])}{rnd.randrange(10**6)}-x.biz" if bad else f"{rnd.choice(['blog', 'news'])}.site.org"
        out.append((f"http://{host}/a/{rnd.randrange(99)}" + ("?ref=1&k=2&id=3" if bad and rnd.random() < 0.7 else ""), int(bad)))
    return out


def test_held_out_accuracy():
    train, test = urls(800, 1), urls(400, 2)
    p = UrlModel.fit([u for u, _ in train], [y for _, y in train]).probability([u for u, _ in test])
    assert np.mean((p >= 0.5) == np.array([y for _, y in test])) > 0.97


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    assert np.mean((BoostedTrees().fit(x[:1500], y[:1500]).probability(x[1500:]) >= 0.5) == y[1500:]) > 0.93


def test_table(spark):
    rows = [(1, "http://a.example.com/en/1"), (2, None), (3, "nothing"), (4, "http://x.org/en/"), (4, "http://x.org/en/"), (None, "http://y.net/es/q"), (5, "http://z.com/" + "a" * 9000)]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = judge(df, OP2_RULES).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got} <= {"allow", "block"}
    by = {r["page_id"]: r for r in got}
    assert (by[1]["rule"], by[1]["verdict"]) == ("example.com/en/", "block") and by[4]["rule"] is None
    assert (by[2]["host"], by[2]["path"], by[3]["host"]) == ("", "", "") and by[None]["verdict"] == "block" and by[5]["verdict"] == "allow"
    assert judge(df.limit(0), OP2_RULES).count() == 0


def judged(spark, urls, rules, most):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in judge(df, rules, max_labelled=most).collect()}
    assert len(got) == len(urls)
    return [got[i] for i in range(len(urls))]


def test_a_rare_verdict_is_sampled(spark):
    # One label in forty is a block.
    rows = [f"http://a{i}.com/q/{i}" for i in range(1500)] + [f"http://b-{i}-x.net/es/{i}" for i in range(40)]
    got = judged(spark, rows + [f"http://c-{i}-y.org/q/{i}" for i in range(10)], OP2_RULES, 60)
    assert all(r["block_score"] >= 0.5 for r in got[1540:]) and np.mean([r["block_score"] < 0.5 for r in got[:1500]]) > 0.95


def test_suffixes_are_counted_beyond_the_sample(spark):
    rules = Rules((("block", "x.com/"), ("allow", "y.com/")))
    rows = [f"http://h{i}.{'xy'[j % 2]}.com/s{j}/{i}" for j in range(400) for i in range(4)]
    got = judged(spark, rows + [f"http://z.org/s{j}/5" for j in range(400)], rules, 200)[1600:]
    assert np.mean([r["verdict"] == ("block", "allow")[j % 2] for j, r in enumerate(got)]) > 0.9


def test_what_a_rule_says_is_no_feature(spark):
    assert OP2_RULES.restated() == {"s:com", "s:net", "p:en", "p:es", "p:fr"}
    rows = [f"http://h{i}.com/q/{i}" for i in range(300)] + [f"http://h{i}.net/es/{i}" for i in range(300)]
    got = judged(spark, rows + [f"http://h{i}.{t}/q/{i}" for t in ("net", "org") for i in range(50)], OP2_RULES, 1000)[600:]
    assert [r["block_score"] for r in got[:50]] == [r["block_score"] for r in got[50:]]


def test_thresholds_come_from_hosts_unseen():
    train, test = urls(800, 3), urls(400, 4)
    hosts = [(u.replace("blog.", f"b{i % 40}."), y) for i, (u, y) in enumerate(train)]
    m = UrlModel.fit([u for u, _ in hosts], [y for _, y in hosts])
    assert 0 < m.threshold < 1 and m.accuracy > 0.9
    assert np.mean((m.probability([u for u, _ in test]) >= m.threshold) == np.array([y for _, y in test])) > 0.9
    assert best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == (0.5, 1.0)


def test_equally_long_rules():
    rules = Rules((("allow", "a.com/x"), ("block", "b.com/x"), ("block", "com/xyz12")))
    assert rules.match("a.com", "/xyz123") == ("com/xyz12", "block") and Rules((("allow", "a.b/x"), ("block", "b/x/y"))).match("a.b", "/x/y") == ("b/x/y", "block")
