"""URL filters: rules by longest match, and gradient-boosted trees on lexical features for the rest.

The rules label the urls they fit; suffix statistics count all of those labels, the trees learn from a
bounded sample of them and judge the urls that no rule fits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, slices

#: Labelled urls that trees are fitted on, at most: those of least hash, half of each label if there are so many.
MAX_LABELLED = 20_000
#: Parts of the labelled urls: a training url's statistics come from the other parts.
FOLDS = 5
_UPPER = {c: c + 32 for c in range(65, 91)}
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host with A-Z lower-cased, path up to ``?`` or ``#``; both empty without ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_UPPER), _PATH.match(url, host.end())[0]


@dataclass(frozen=True)
class Rules:
    """(verdict, pattern) pairs; a pattern is a host, a slash and the beginning of a path."""

    rules: tuple[tuple[str, str], ...]

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule (pattern, verdict) whose host is this one or a parent domain of it."""
        best = None
        for verdict, pattern in self.rules:
            h, _, rest = pattern.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + rest):
                if best is None or (len(pattern), pattern) > (len(best[0]), best[0]):
                    best = (pattern, verdict)
        return best

    def restated(self) -> frozenset[str]:
        """Suffix keys that would only give a rule back: the last label of its host and its first path segment."""
        parts = [pattern.partition("/") for _, pattern in self.rules]
        return frozenset(["s:" + h.rsplit(".", 1)[-1] for h, *_ in parts] + ["p:" + r.split("/")[0] for *_, r in parts if r])


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


NAMES = (
    "length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio",
    "hyphens", "entropy", "host_entropy", "parameters", "fragment", "https", "trailing_slash", "longest_segment",
    "suffix_rate", "suffix_count", "file_rate", "first_segment_rate", "first_segment_count",
)


def _suffixes(host: str, path: str) -> tuple[str, str, str]:
    """Keys whose labels are counted: last label of the host, file ending, first path segment."""
    last = path.rsplit("/", 1)[-1]
    parts = path.split("/")
    return "s:" + host.rsplit(".", 1)[-1], "f:" + (last.rsplit(".", 1)[1] if "." in last else ""), "p:" + (parts[1] if len(parts) > 2 else "")


def _fold(url: str) -> int:
    """The part of a url's host: urls of a host are never on both sides."""
    return xxhash.xxh3_64_intdigest(split_url(url)[0]) % FOLDS


def _features(url: str, host: str, path: str, keys: Sequence[tuple[float, float]]) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(query), host.count("."), path.count("/"), digits / max(1, len(url)),
        sum(c.isdigit() for c in host) / max(1, len(host)), url.count("-"), _entropy(url), _entropy(host),
        len([p for p in query.split("&") if p]), float("#" in url), float(url.startswith("https:")), float(path.endswith("/")),
        max(map(len, path.split("/")), default=0), keys[0][0], keys[0][1], keys[1][0], keys[2][0], keys[2][1],
    ]


def _key_stats(y: float, n: float, prior: float) -> tuple[float, float]:
    """Rate and count of a suffix of which y of n labelled urls are blocked."""
    return (y + 4 * prior) / (n + 4), math.log1p(n)


def _suffix_counts(urls: Sequence[str], blocked: Sequence[int], skip: frozenset[str] = frozenset()) -> dict[tuple[str, int], list[int]]:
    """[blocked, all] of the urls by suffix and fold; suffixes in ``skip`` aren't counted."""
    counts: dict[tuple[str, int], list[int]] = {}
    for url, y in zip(urls, blocked):
        fold = _fold(url)
        for k in set(_suffixes(*split_url(url))) - skip:
            c = counts.setdefault((k, fold), [0, 0])
            c[0] += y
            c[1] += 1
    return counts


class BoostedTrees:
    """Binary log-loss boosting with histogram splits; trees are arrays (feature, bound, left, leaf values)."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weights is None else weights
        p = ((w * y).sum() + 0.5) / (w.sum() + 1)
        self.base = math.log(p / (1 - p))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T] if len(x) else []
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if len(x) else x
        f = np.full(len(y), self.base)
        for _ in range(self.n if len(np.unique(y)) > 1 else 0):
            q = 1 / (1 + np.exp(-f))
            grad, hess = w * (y - q), w * q * (1 - q)
            tree: list[tuple] = []
            f += self.rate * self._grow(binned, edges, grad, hess, np.arange(len(y)), self.depth, tree, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, b, edges, g, h, at, depth, tree, out) -> np.ndarray:
        """Appends nodes (feature, bound, left, right) or (None, value) depth-first; out gets leaf values."""
        me = len(tree)
        tree.append(None)
        best = (1e-6, None, None)
        if depth and len(at) >= 2 * self.least:
            total_g, total_h = g[at].sum(), h[at].sum()
            whole = total_g**2 / (total_h + self.ridge)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                col = b[at, j]
                cg = np.cumsum(np.bincount(col, g[at], len(e) + 1))[:-1]
                ch = np.cumsum(np.bincount(col, h[at], len(e) + 1))[:-1]
                cn = np.cumsum(np.bincount(col, minlength=len(e) + 1))[:-1]
                gain = cg**2 / (ch + self.ridge) + (total_g - cg) ** 2 / (total_h - ch + self.ridge) - whole
                gain[(cn < self.least) | (len(at) - cn < self.least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        _, j, k = best
        if j is None:
            value = float(g[at].sum() / (h[at].sum() + self.ridge))
            tree[me] = (None, value)
            out[at] = value
            return out
        go = b[at, j] <= k
        left = len(tree)
        self._grow(b, edges, g, h, at[go], depth - 1, tree, out)
        right = len(tree)
        self._grow(b, edges, g, h, at[~go], depth - 1, tree, out)
        tree[me] = (j, float(edges[j][k]), left, right)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self.rate * self._leaf(tree, 0, x, np.arange(len(x)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-f))

    def _leaf(self, tree, me, x, at, out) -> np.ndarray:
        node = tree[me]
        if node[0] is None:
            out[at] = node[1]
        else:
            go = x[at, node[0]] <= node[1]
            for side, part in ((node[2], at[go]), (node[3], at[~go])):
                if len(part):
                    self._leaf(tree, side, x, part, out)
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The threshold of highest balanced accuracy (ties: the nearest to 1/2), and that accuracy."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    # Blocked from place i on: the blocked there and the allowed before are right.
    right1 = np.append(np.cumsum(y[::-1])[::-1], 0) / y.sum()
    right0 = np.append(0, np.cumsum(1 - y)) / (1 - y).sum()
    cuts = np.concatenate([[0.0], (p[1:] + p[:-1]) / 2, [1.0]])
    ok = np.concatenate([[True], p[1:] > p[:-1], [True]])
    score = np.where(ok, (right1 + right0) / 2, -1)
    best = np.lexsort((np.abs(cuts - 0.5), -np.round(score, 9)))[0]
    return float(cuts[best]), float(score[best])


@dataclass
class UrlModel:
    """Probability that a url is to be blocked. threshold and accuracy (balanced: the mean over both labels)
    come from hosts that the trees behind them haven't seen; accuracy is None where no such hosts are labelled."""

    trees: BoostedTrees
    prior: float
    totals: dict[str, list[int]]
    threshold: float = 0.5
    accuracy: float | None = None

    @classmethod
    def fit(
        cls,
        urls: Sequence[str],
        blocked: Sequence[int],
        counts: dict[tuple[str, int], list[int]] | None = None,
        sizes: tuple[int, int] | None = None,
    ) -> UrlModel:
        """Suffix statistics of a training url come from the other folds, so trees can't read its label there.

        counts and sizes, by label, cover all labelled urls; without them, those given are all.
        """
        y = np.array(blocked, dtype=float)
        counts = _suffix_counts(urls, blocked) if counts is None else counts
        n0, n1 = sizes or (int((y == 0).sum()), int(y.sum()))
        prior = (n1 + 0.5) / (n0 + n1 + 1)
        totals: dict[str, list[int]] = {}
        for (k, _), (a, n) in counts.items():
            t = totals.setdefault(k, [0, 0])
            t[0] += a
            t[1] += n
        x = np.zeros((len(urls), len(NAMES)))
        for i, url in enumerate(urls):
            parts, fold, keys = split_url(url), _fold(url), []
            for k in _suffixes(*parts):
                (a, n), own = totals.get(k, (0, 0)), counts.get((k, fold), (0, 0))
                keys.append(_key_stats(a - own[0], n - own[1], prior) if n > own[1] else (prior, 0.0))
            x[i] = _features(url, *parts, keys)
        # Sampled urls stand for all of their label.
        of = {0: n0 / max(1, int((y == 0).sum())), 1: n1 / max(1, int(y.sum()))}
        w = np.array([of[int(v)] for v in y])
        model = cls(BoostedTrees().fit(x, y, w), prior, totals)
        fold = np.array([_fold(u) for u in urls])
        p = np.full(len(y), np.nan)
        # Two parts are held out, so that few hosts don't decide.
        for f in (0, 1):
            rest = fold != f
            if rest.any() and not rest.all():
                p[~rest] = BoostedTrees().fit(x[rest], y[rest], w[rest]).probability(x[~rest])
        seen = ~np.isnan(p)
        if len(np.unique(y[seen])) == 2:
            model.threshold, model.accuracy = best_threshold(p[seen], y[seen])
        return model

    def judge(self, urls: Sequence[str], counts: Sequence[Sequence[tuple[int, int]]]) -> np.ndarray:
        """Probabilities, by the counts (blocked, all) of each url's suffixes."""
        rows = [
            _features(u, *split_url(u), [_key_stats(a, n, self.prior) if n else (self.prior, 0.0) for a, n in c])
            for u, c in zip(urls, counts)
        ]
        return self.trees.probability(np.array(rows).reshape(len(urls), len(NAMES)))

    def probability(self, urls: Sequence[str]) -> np.ndarray:
        return self.judge(urls, [[self.totals.get(k, (0, 0)) for k in _suffixes(*split_url(u))] for u in urls])


def judge(pages: DataFrame, rules: Rules, threshold: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of ``pages`` (page_id, url).

    rule is the pattern that fits or null (of equally long ones the last by code point); verdict is its,
    else the model's: block where block_score, the model's probability, reaches the threshold, by default
    the best one on hosts held out. Suffix statistics count all distinct urls with a rule, but no suffix
    that a rule is made of; at most ``max_labelled`` urls, of both labels alike, train the trees. Null urls and such without ``://`` have empty host and path and are
    judged by the model as the empty url. Without labels of both kinds every url gets the prior. Repeated
    rows are judged alike; an empty table gives no rows.
    """
    spark, skip = pages.sparkSession, rules.restated()
    lean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            urls = list(dict.fromkeys(u for u in batch.column("url").to_pylist() if u))
            hits = [(u, m[1] == "block") for u in urls if (m := rules.match(*split_url(u)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in hits], pa.string()), pa.array([int(b) for _, b in hits], pa.int32())],
                names=["url", "blocked"],
            )

    labelled = materialise(lean.select("url").mapInArrow(label, "url string, blocked int").distinct(), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _suffix_counts(batch.column("url").to_pylist(), batch.column("blocked").to_pylist(), skip)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in counts], pa.string()),
                    pa.array([f for _, f in counts], pa.int32()),
                    pa.array([a for a, _ in counts.values()], pa.int64()),
                    pa.array([n for _, n in counts.values()], pa.int64()),
                ],
                names=["k", "fold", "y", "n"],
            )

    stats = materialise(
        labelled.mapInArrow(count, "k string, fold int, y long, n long")
        .groupBy("k", "fold")
        .agg(F.sum("y").alias("y"), F.sum("n").alias("n")),
        "suffixes",
    )
    totals = stats.groupBy("k").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    by_label = {r["blocked"]: r["count"] for r in labelled.groupBy("blocked").count().collect()}
    n0, n1 = by_label.get(0, 0), by_label.get(1, 0)
    take1 = min(n1, max(max_labelled // 2, max_labelled - n0))
    sample = [
        (r["url"], y)
        for y, most in ((0, max_labelled - take1), (1, take1))
        for r in labelled.filter(F.col("blocked") == y).orderBy(F.expr("xxhash64(url, 2)"), "url").limit(most).collect()
    ]
    own = {k for u, _ in sample for k in _suffixes(*split_url(u))}
    found = stats.join(F.broadcast(spark.createDataFrame([(k,) for k in own], "k string")), "k", "left_semi").toArrow()
    counts = {(k, f): [a, n] for k, f, a, n in zip(*(found.column(c).to_pylist() for c in ("k", "fold", "y", "n")))}
    fitted = UrlModel.fit([u for u, _ in sample], [y for _, y in sample], counts, (n0, n1))
    bar = fitted.threshold if threshold is None else threshold
    # The rows bring their own counts along, so those of the sample stay here.
    model = spark.sparkContext.broadcast(UrlModel(fitted.trees, fitted.prior, {}))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [_suffixes(*split_url(u or "")) for u in batch.column("url").to_pylist()]
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["page_id", "url", "k0", "k1", "k2"])

    wide = lean.mapInArrow(suffixes, "page_id long, url string, k0 string, k1 string, k2 string")
    for i in range(3):
        wide = wide.join(totals.select(F.col("k").alias(f"k{i}"), F.col("y").alias(f"y{i}"), F.col("n").alias(f"n{i}")), f"k{i}", "left")
    wide = wide.select("page_id", "url", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for i in range(3) for c in (f"y{i}", f"n{i}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            urls = [u or "" for u in batch.column("url").to_pylist()]
            parts = [split_url(u) for u in urls]
            found = [rules.match(*p) for p in parts]
            pairs = [zip(batch.column(f"y{i}").to_pylist(), batch.column(f"n{i}").to_pylist()) for i in range(3)]
            p = model.value.judge(urls, list(zip(*pairs))) if urls else np.array([])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([q for _, q in parts], pa.string()),
                    pa.array([m[0] if m else None for m in found], pa.string()),
                    pa.array([m[1] if m else "block" if s >= bar else "allow" for m, s in zip(found, p)], pa.string()),
                    pa.array(p, pa.float64()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "block_score"],
            )

    return wide.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_score double")


OP2_RULES = Rules(
    (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), OP2_RULES)
