"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled texts is indexed by all their words; a word's weight is its idf over all
documents, times a factor that rises with its association with the label and never reaches 0. A text's
neighbours among the examples are exact: blocks of examples are visited by descending upper bound until
no bound reaches the k-th best cosine. Votes weigh 1 / (distance + 0.05), and isotonic regression over
leave-one-out votes turns them into probabilities. A text is never its own neighbour, nor are its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, release
from .words import char_hashes, text_slices

#: At most so many examples of each label, those of least hash, are learnt from and indexed.
MAX_EXAMPLES = 4096
#: Least factor of a word: that of words whose likelihood ratio may be chance.
LEAST_FACTOR = 0.01
NEIGHBOURS, BLOCK, SHOWN = 16, 64, 5
#: Texts that search the index together, and bytes of text that a worker takes at once.
TOGETHER, SLICE = 64, 2 << 20
THRESHOLD = 0.3
#: Counts of so many words go in one row of a shuffle.
CHUNK = 8192


def text_hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of whole texts (a null text is empty)."""
    return np.array([xxhash.xxh3_64_intdigest(t) for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()], dtype=np.uint64)


def count_terms(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the known words of each text and how often it has them, and how many of these each text has."""
    h, per = char_hashes(texts)
    at = pc.fill_null(pc.index_in(pa.array(h), value_set=words), -1).to_numpy().astype(np.int64)
    known = at >= 0
    key = np.repeat(np.arange(len(per)), per)[known] * max(1, len(words)) + at[known]
    key.sort()
    first = _firsts(key)
    doc, term = np.divmod(key[first], max(1, len(words)))
    return term, np.diff(np.append(first, len(key))), np.bincount(doc, minlength=len(per))


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


@dataclass
class BlockMaxIndex:
    """Unit vectors as postings by term. Terms that many examples have are kept as rows of a matrix instead,
    with their largest weight in each block of examples."""

    keys: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray = field(repr=False)
    at: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    width: int = 64

    @classmethod
    def build(cls, keys: np.ndarray, hashes: np.ndarray, per: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """Of vectors one after the other: ``per`` has each one's number of terms."""
        n, own = len(keys), np.repeat(np.arange(len(keys)), per)
        # Examples that share their weightiest term lie together, so block maxima are tight.
        heavy = np.full(n, -1, dtype=np.int64)
        by_weight = np.lexsort((terms, weights))
        heavy[own[by_weight]] = terms[by_weight]
        order = np.lexsort((keys, heavy))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        by_term = np.lexsort((place[own], terms))
        starts = np.searchsorted(terms[by_term], np.arange(n_terms + 1)).astype(np.int32)
        return cls(keys[order], hashes[order], starts, place[own][by_term].astype(np.int32), weights[by_term], block)

    def __getstate__(self) -> dict:
        # Workers derive the rest anew, so it needn't travel.
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def forget(self) -> None:
        """Drop what searches derive from the postings; the next search derives it again."""
        self.__dict__ = self.__getstate__()

    def _prepare(self) -> None:
        n, n_terms = len(self.keys), len(self.starts) - 1
        self._blocks = -(-n // self.width)
        # Rows pay where a multiplication costs less than following postings.
        dense = np.flatnonzero(np.diff(self.starts) > max(16, n // 16))
        self._row = np.full(n_terms, -1, dtype=np.int32)
        self._row[dense] = np.arange(len(dense))
        self._matrix = np.zeros((len(dense), self._blocks * self.width), dtype=np.float32)
        term = np.repeat(self._row, np.diff(self.starts))
        some = term >= 0
        self._matrix[term[some], self.at[some]] = self.weight[some]
        self._tops = self._matrix.reshape(len(dense), self._blocks, self.width).max(axis=2) if n else np.zeros((0, 0), np.float32)
        by_vector = np.argsort(self.at, kind="stable")
        self._v_term = np.repeat(np.arange(n_terms, dtype=np.int32), np.diff(self.starts))[by_vector]
        self._v_weight = self.weight[by_vector]
        self._v_starts = np.searchsorted(self.at[by_vector], np.arange(n + 1))
        self._query = np.zeros(n_terms)

    def search(
        self, terms: np.ndarray, weights: np.ndarray, per: np.ndarray, k: int, without: np.ndarray | None = None, step: int = 8
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, positions) of each query's k nearest, ties to the smaller key; cosines of 0 don't count.

        Queries lie one after the other (``per``: terms of each); examples whose text has a query's hash in
        ``without`` are none of its neighbours. Postings of the rarer terms are added up first; a block's
        bound is the best such sum in it and the block maxima of the others. Each query visits blocks by
        descending bound, until the bounds of all others are below its k-th best cosine; what may be among
        its k is scored exactly.
        """
        if not hasattr(self, "_matrix"):
            self._prepare()
        m, n, nb = len(per), len(self.keys), self._blocks
        if not n:
            return [(np.zeros(0), np.zeros(0, dtype=np.int64))] * m
        doc = np.repeat(np.arange(m), per)
        row = self._row[terms]
        q = np.zeros((m, len(self._matrix)), dtype=np.float32)
        q[doc[row >= 0], row[row >= 0]] = weights[row >= 0]
        rare = np.flatnonzero(row < 0)
        first = self.starts[terms[rare]].astype(np.int64)
        length = self.starts[terms[rare] + 1] - first
        flat, size = _expand(first, length), nb * self.width
        cell = np.repeat(doc[rare] * size, length) + self.at[flat]
        scores = np.bincount(cell, weights=self.weight[flat] * np.repeat(weights[rare], length), minlength=m * size).astype(np.float32).reshape(m, size)
        del flat, cell
        if without is not None:
            scores[:, :n][self.hashes[None, :] == without[:, None]] = -9.0
        bounds = scores.reshape(m, nb, self.width).max(axis=2) + q @ self._tops
        visited, bar, slack = np.zeros((m, nb), dtype=bool), np.zeros(m), 1e-5
        while True:
            open_ = ~visited & (bounds > 0) & (bounds >= bar[:, None] - slack)
            if not open_.any():
                break
            if step < nb:
                last = -np.partition(-np.where(open_, bounds, -1.0), step, axis=1)[:, step]
                open_ &= bounds >= last[:, None]
            visited |= open_
            for b in np.flatnonzero(open_.any(axis=0)):
                own = np.flatnonzero(open_[:, b])
                cols = slice(b * self.width, (b + 1) * self.width)
                scores[own, cols] += q[own] @ self._matrix[:, cols]
            for i in np.flatnonzero(open_.any(axis=1)):
                # Only what reaches the bar so far can lift it.
                top = scores[i][scores[i] > bar[i]]
                if len(top) >= k:
                    bar[i] = np.partition(top, len(top) - k)[len(top) - k]
            step *= 16
        return [self._exact(terms[e - c : e], weights[e - c : e], np.flatnonzero((s > 0) & (s >= x - slack)), k) for e, c, s, x in zip(np.cumsum(per), per, scores, bar)]

    def _exact(self, terms: np.ndarray, weights: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(found):
            return np.zeros(0), found
        self._query[terms] = weights
        runs = [slice(a, b) for a, b in zip(self._v_starts[found].tolist(), self._v_starts[found + 1].tolist())]
        parts = self._query[np.concatenate([self._v_term[r] for r in runs])] * np.concatenate([self._v_weight[r] for r in runs])
        near = np.add.reduceat(parts, np.cumsum([0, *(r.stop - r.start for r in runs[:-1])]))
        self._query[terms] = 0.0
        near = np.round(near, 12)
        best = np.lexsort((self.keys[found], -near))[:k]
        return near[best], found[best]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[list[float], list[float]]:
    """Rising (x, probability) points of the weighted isotonic fit; each level is drawn a little to the prior."""
    merged: list[list[float]] = []
    for a in np.argsort(x, kind="stable"):
        merged.append([x[a] * w[a], y[a] * w[a], w[a]])
        while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
            last = merged.pop()
            merged[-1] = [p + q for p, q in zip(merged[-1], last)]
    ps = np.maximum.accumulate([(m[1] + prior) / (m[2] + 1) for m in merged]).tolist()
    return [m[0] / m[2] for m in merged], ps


@dataclass
class Model:
    """words: hashes of all words of the examples; factors: their idf times their association with the label."""

    words: np.ndarray
    factors: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    blank: float
    curve: tuple[list[float], list[float]] = ((), ())

    def vectors(self, term: np.ndarray, n: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Weights of the terms: vectors of length 1, one after the other."""
        w = (1 + np.log(n)) * self.factors[term]
        own = np.repeat(np.arange(len(per)), per)
        return w / np.sqrt(np.bincount(own, weights=w * w, minlength=len(per)))[own]

    def vote(self, near: np.ndarray, at: np.ndarray) -> float:
        w = self.weights[at] / (1.05 - np.minimum(near, 1.0))
        return float((0.2 * self.prior + (w * self.labels[at]).sum()) / (0.2 + w.sum()))

    def score(self, near: np.ndarray, at: np.ndarray) -> tuple[float, list[int]]:
        """Probability of the label by the nearest examples, and their doc_ids."""
        if not len(at):
            return self.blank, []
        raw = self.vote(near, at)
        p = float(np.interp(raw, *self.curve))
        return min(1.0, max(0.0, 0.98 * p + 0.02 * raw)), self.index.keys[at[:SHOWN]].tolist()


def _examples(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """The rows of the sampled examples (text, label, key), one per distinct text; and all labels' counts."""
    spark = docs.sparkSession
    held = F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [
        (r["doc_id"], r["label"])
        for y in (0, 1)
        for r in known.filter(F.col("label") == y).orderBy(F.expr("xxhash64(doc_id, 5)"), "doc_id").limit(limit).collect()
    ]
    chosen = spark.createDataFrame(picked, "key long, label int")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("key"))
        .groupBy(F.expr("xxhash64(text)").alias("h"), "text")
        .agg(F.min(F.struct(-F.col("label"), "key")).alias("m"))
        .select("text", (-F.col("m.col1")).alias("label"), F.col("m.key").alias("key"))
    )
    return rows, counts


def document_frequencies(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` (text) each word occurs, and the number of rows."""
    if not len(words):
        return np.zeros(0, dtype=np.int64), docs.count()
    shared, schema = docs.sparkSession.sparkContext.broadcast(words), "k long, n binary"

    def rows_of(n: np.ndarray) -> pa.RecordBatch:
        ks = range(0, len(n), CHUNK)
        return pa.RecordBatch.from_arrays(
            [pa.array([k // CHUNK for k in ks], pa.int64()), pa.array([n[k : k + CHUNK].tobytes() for k in ks], pa.binary())], names=["k", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value)
        n, docs_ = np.zeros(len(known), dtype=np.int32), 0
        for part in text_slices(batches, SLICE):
            n += np.bincount(count_terms(part.column("text"), known)[0], minlength=len(n)).astype(np.int32)
            docs_ += part.num_rows
        yield rows_of(np.append(n, np.int32(docs_)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, dtype=np.int32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema).repartition("k").mapInArrow(add, schema).toArrow()
    n = np.zeros(len(words) + 1, dtype=np.int64)
    for k, raw in zip(got.column("k").to_pylist(), got.column("n").to_pylist()):
        n[k * CHUNK : (k + 1) * CHUNK] += np.frombuffer(raw, dtype=np.int64)
    return n[:-1], int(n[-1])


def association(n1: np.ndarray, n0: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """A word's factor by the likelihood ratio of its examples (n1 of all1, n0 of all0): from LEAST_FACTOR to 1."""
    if not all1 or not all0:
        return np.ones(len(n1))
    share = (n1 + n0) / (all1 + all0)
    ratio = np.zeros(len(n1))
    for o, m, g in ((n1, all1, share), (all1 - n1, all1, 1 - share), (n0, all0, share), (all0 - n0, all0, 1 - share)):
        ratio += np.where(o > 0, 2 * o * np.log(np.maximum(o, 1e-9) / np.maximum(m * g, 1e-9)), 0.0)
    # Among so many words chance alone reaches twice the logarithm of their number; a quarter is given at 4 times that.
    chance = 2 * np.log(max(2, len(n1)))
    return LEAST_FACTOR + (1 - LEAST_FACTOR) * (ratio / (ratio + 4 * chance)) ** 2


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text), held-out rows apart.

    At most ``max_examples`` of each label are used, each with all its words; document frequencies cover all
    rows of ``docs``. Null labels and ids are ignored; of several labels of an id or of copies of a text the
    highest holds. Without labels every score is 1/2, without examples of both the share of the label.
    """
    examples, counts = _examples(docs, labels, max_examples)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            h, per = char_hashes(part.column("text"))
            own = np.repeat(np.arange(len(per)), per)
            order = np.lexsort((h, own))
            h, own = h[order], own[order]
            first = _firsts(own, h)
            off = pa.array(np.searchsorted(own[first], np.arange(len(per) + 1)).astype(np.int32))
            n = np.diff(np.append(first, len(h))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("label"),
                    pa.array(text_hashes(part.column("text")).view(np.int64)),
                    pa.ListArray.from_arrays(off, pa.array(h[first])),
                    pa.ListArray.from_arrays(off, pa.array(n)),
                ],
                names=["key", "label", "hash", "w", "n"],
            )

    schema = "key long, label int, hash long, w array<long>, n array<int>"
    got = examples.select("text", "label", "key").mapInArrow(hashed, schema).toArrow().sort_by("key")
    keys, label = got.column("key").to_numpy(), got.column("label").to_numpy().astype(float)
    hashes = got.column("hash").to_numpy().view(np.uint64)
    lists, n = got.column("w").combine_chunks(), got.column("n").combine_chunks().flatten().to_numpy()
    per = np.diff(lists.offsets.to_numpy())
    words, term = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    own = np.repeat(np.arange(len(keys)), per)
    del got, lists
    n1 = np.bincount(term, weights=label[own], minlength=len(words))
    n0 = np.bincount(term, minlength=len(words)) - n1
    df, rows = document_frequencies(docs, words)
    idf = np.log((1 + rows) / (1 + df)) + 1
    factors = idf * association(n1, n0, label.sum(), len(label) - label.sum())
    return make_model(keys, hashes, label, term, n, per, words, factors, counts)


def make_model(
    keys: np.ndarray, hashes: np.ndarray, label: np.ndarray, term: np.ndarray, n: np.ndarray, per: np.ndarray, words: np.ndarray, factors: np.ndarray, counts: dict[int, int]
) -> Model:
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = counts.get(1, 0) / total if total else 0.5
    # Where a label was sampled, its examples stand for all that bear it.
    of = np.array([counts.get(y, 0) / max(1, int((label == y).sum())) for y in (0, 1)])
    weight = of[label.astype(int)]
    blank = per == 0
    w1, w0 = (weight * label)[blank].sum(), (weight * (1 - label))[blank].sum()
    model = Model(words, factors, BlockMaxIndex.build(keys[:0], hashes[:0], per[:0], term[:0], factors[:0], len(words)), label, weight, prior, float((w1 + prior) / (w1 + w0 + 1)))
    if blank.all():
        return model
    vectors = model.vectors(term, n, per)
    model.index = index = BlockMaxIndex.build(keys[~blank], hashes[~blank], per[~blank], term, vectors, len(words))
    at = np.searchsorted(keys, index.keys)
    model.labels, model.weights = label[at], weight[at] / weight[at].min()
    starts, raw = np.cumsum(per) - per, []
    for k in range(0, len(at), TOGETHER):
        some = at[k : k + TOGETHER]
        flat = _expand(starts[some], per[some])
        for near, pos in index.search(term[flat], vectors[flat], per[some], NEIGHBOURS, hashes[some]):
            raw.append(model.vote(near, pos) if len(pos) else prior)
    model.curve = isotonic(np.array(raw), model.labels, weight[at], prior)
    index.forget()
    release()
    return model


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("tox_score", "tox_evidence")) -> DataFrame:
    """``docs`` (text, any others) with a score (0 to 1) and evidence (doc_ids of the nearest examples).

    Whole texts are read; a null or empty text, or one without a word of any example, has the share of the
    label among such examples. Equal texts have equal scores: examples of the same text take no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = pa.array(m.words)
        for part in text_slices(batches, SLICE):
            texts = part.column("text").cast(pa.string())
            term, n, per = count_terms(texts, words)
            w, hashes, ends = m.vectors(term, n, per), text_hashes(texts), np.append(0, np.cumsum(per))
            scores, evidence = [], []
            for k in range(0, len(per), TOGETHER):
                own = per[k : k + TOGETHER]
                part_ = slice(ends[k], ends[k + len(own)])
                for near, at in m.index.search(term[part_], w[part_], own, NEIGHBOURS, hashes[k : k + TOGETHER]):
                    s, e = m.score(near, at)
                    scores.append(s)
                    evidence.append(e)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=[*part.schema.names, *names]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with the columns of ``docs``, whatever their names."""
    names = ["tox_score", "tox_evidence"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [n + "_" for n in names]
    return score(docs, fit(docs, labels), tuple(names)).filter(F.col(names[0]) < threshold).select(docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    held = F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)")
    return score(docs, model).select(
        "doc_id",
        held.alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("tox_evidence").alias("evidence"),
    )
