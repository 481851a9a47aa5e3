"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Events are the words seen in training, the end of a text, and one event for all other words. Words of a
certain share (the head) fall into topic groups, and those of a group into classes by frequency, the most
frequent words into small ones; all other words share a class. The words of a class are the leaves of a tree
whose branches have about equal mass. A token's chance is that of its group, of its class within the group,
and of each branch down to its word. All of these depend on hashed features of the words before (the last
one, the last two, and skips to the second, third and fourth), by softmaxes whose weights are trained in rounds: each partition makes gradient steps of its own over all its
positions, and the changes are averaged per feature by how often it occurred. Within the tail class, words go by bands of their training count, whose chances are
those of words whose own document is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, release
from .words import byte_hashes, text_slices

#: Head words have at least this share of the training tokens (so there are 2^23 at most: the bound of what is
#: broadcast) and this count: what is left out of one document is judged in the tail.
HEAD_SHARE, HEAD_COUNT = 2.0**-23, 8
#: Anchors are the most frequent words; their groups, and the classes of a group (and branches of a node).
ANCHORS, GROUPS, LEVELS = 96, 6, 8
#: Rows of weights for nodes within classes, by feature row: nodes share them by their number.
SLOTS = 8
ROUNDS, STEP, BATCH = 2, 0.15, 65_536
#: Head words for each row of weights: the rows follow the vocabulary, in powers of two.
WORDS_PER_ROW, LEAST_ROWS = 16, 1 << 12
SMOOTH = 0.1
#: Words before a token that its class may depend on.
CONTEXT = 4
#: Training counts of tail words are exact up to here, then in doubling bands.
EXACT = 16
#: Bytes of text that a worker takes at once, and weights that one row of a shuffle holds.
SLICE, CHUNK = 4 << 20, 256
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def is_training(column: str = "doc_id"):
    """Whether a row may be learnt from: crc32 of its id as text isn't divisible by 10 (a null id: not)."""
    return F.expr(f"coalesce(pmod(crc32(cast(cast({column} as string) as binary)), 10) <> 0, false)")


def band(count: np.ndarray) -> np.ndarray:
    c = np.asarray(count, dtype=np.int64)
    big = EXACT + np.floor(np.log2(np.maximum(c, 1) / EXACT)).astype(np.int64) + 1
    return np.where(c <= EXACT, c, big)


def _band_sql(c: str) -> str:
    return f"if({c} <= {EXACT}, cast({c} as int), {EXACT} + cast(floor(log2({c} / {EXACT}.0D)) as int) + 1)"


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """h (hash of a word), c (its count), df (documents with it) over all rows of ``docs`` (text)."""

    def count(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        doc, h = np.repeat(np.arange(len(per)), per)[order], h[order]
        at = _runs(h)
        new = np.concatenate([[1], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        return h[at], np.diff(np.append(at, len(h))), np.add.reduceat(new, at)

    def merge(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, c, df = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, c, df = h[order], c[order], df[order]
        at = _runs(h)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[at]), pa.array(np.add.reduceat(c, at).astype(np.int64)), pa.array(np.add.reduceat(df, at).astype(np.int64))],
            names=["h", "c", "df"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in text_slices(batches, SLICE):
            h, per = byte_hashes(part.column("text"))
            if len(h):
                held.append(count(h, per))
                size += len(held[-1][0])
            if size > 2_000_000:
                yield merge(held)
                held, size = [], 0
        if held:
            yield merge(held)

    return (
        docs.select(F.col("text").cast("string"))
        .mapInArrow(run, "h long, c long, df long")
        .groupBy("h")
        .agg(F.sum("c").alias("c"), F.sum("df").alias("df"))
    )


def encode(docs: DataFrame, head: np.ndarray) -> DataFrame:
    """rid, doc_id, train, n, seq (uint32 head indices; len(head) for a tail word), tail (hashes, counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rid = pa.array(shared.value), TaskContext.get().partitionId() << 36
        for part in text_slices(batches, SLICE):
            h, per = byte_hashes(part.column("text"))
            idx = pc.fill_null(pc.index_in(pa.array(h), value_set=known), len(known)).to_numpy().astype("<u4")
            ends = np.cumsum(per)
            tail = np.flatnonzero(idx == len(known))
            doc, t = np.searchsorted(ends, tail, side="right"), h[tail]
            order = np.lexsort((t, doc))
            doc, t = doc[order], t[order]
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])])) if len(t) else np.zeros(0, dtype=np.int64)
            off = pa.array(np.searchsorted(doc[at], np.arange(len(per) + 1)).astype(np.int32))
            raw = pa.py_buffer(idx)
            seq = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer((4 * np.append(0, ends)).astype(np.int32)), raw])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + len(per))),
                    part.column("doc_id"),
                    part.column("train"),
                    pa.array(per.astype(np.int64)),
                    seq,
                    pa.ListArray.from_arrays(off, pa.array(t[at])),
                    pa.ListArray.from_arrays(off, pa.array(np.diff(np.append(at, len(t))).astype(np.int32))),
                ],
                names=["rid", "doc_id", "train", "n", "seq", "tail_h", "tail_n"],
            )
            rid += len(per)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_training().alias("train")
    ).mapInArrow(run, "rid long, doc_id long, train boolean, n long, seq binary, tail_h array<long>, tail_n array<int>")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of a few million bytes, their sequences one after the other, and the length of each."""
    for batch in text_slices(batches, SLICE, "seq"):
        seq = batch.column("seq").cast(pa.large_binary())
        at = np.frombuffer(seq.buffers()[1], dtype=np.int64)[seq.offset : seq.offset + len(seq) + 1]
        raw = seq.buffers()[2]
        flat = np.frombuffer(raw, dtype="<u4")[at[0] // 4 : at[-1] // 4] if raw is not None and at[-1] else np.zeros(0, dtype="<u4")
        yield batch, flat.astype(np.int64), np.diff(at) // 4


def anchor_groups(coded: DataFrame, anchors: int, groups: int) -> np.ndarray:
    """A group for each anchor: agglomeration of their document co-occurrence (mean pointwise information)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((anchors + 1, anchors + 1))
        for _, flat, per in _sequences(batches):
            at = np.flatnonzero(flat < anchors)
            x = np.zeros((len(per), anchors + 1), dtype=np.float32)
            x[np.searchsorted(np.cumsum(per), at, side="right"), flat[at]] = 1
            x[:, anchors] = 1
            m += x.T @ x
        i, j = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(m[i, j])], names=["i", "j", "n"])

    got = coded.select("seq").mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    m = np.zeros((anchors + 1, anchors + 1))
    for r in got:
        m[r["i"], r["j"]] = r["n"]
    own = np.diag(m)[:anchors]
    pmi = np.log((m[:anchors, :anchors] + 0.5) * max(m[anchors, anchors], 1) / np.maximum(np.outer(own, own), 1))
    parts = [[i] for i in range(anchors)]
    while len(parts) > groups:
        best = max(
            ((pmi[np.ix_(parts[a], parts[b])].mean(), -a, -b) for a in range(len(parts)) for b in range(a)), default=None
        )
        a, b = -best[1], -best[2]
        parts[b] += parts.pop(a)
    out = np.zeros(anchors, dtype=np.int64)
    for g, p in enumerate(sorted(parts, key=min)):
        out[p] = g
    return out


def main_groups(coded: DataFrame, groups: np.ndarray, n_groups: int, size: int) -> np.ndarray:
    """The group of most occurrences of each head word, by the groups of documents (that of most of its
    anchors); n_groups where that is less than 60 %."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((n_groups, size), dtype=np.int64)
        for _, flat, per in _sequences(batches):
            doc = np.repeat(np.arange(len(per)), per)
            at = np.flatnonzero(flat < len(groups))
            # Weigh an anchor by its rank, lest those of every group decide.
            votes = np.bincount(doc[at] * n_groups + groups[flat[at]], weights=np.log(2 + flat[at]), minlength=len(per) * n_groups)
            votes = votes.reshape(-1, n_groups)
            own = np.where(votes.any(axis=1), votes.argmax(axis=1), -1)[doc]
            for g in range(n_groups):
                w = flat[own == g]
                m[g] += np.bincount(w[w < size], minlength=size)
        at = np.flatnonzero(m.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *(pa.array(m[g, at]) for g in range(n_groups))], names=["i", *(f"g{g}" for g in range(n_groups))]
        )

    cols = [f"g{g}" for g in range(n_groups)]
    sums = coded.select("seq").mapInArrow(run, "i long, " + ", ".join(f"{c} long" for c in cols)).groupBy("i").agg(*(F.sum(c).alias(c) for c in cols))
    best = f"array_max(array({', '.join(cols)}))"
    main = f"if({best} >= 0.6 * ({' + '.join(cols)}), cast(array_position(array({', '.join(cols)}), {best}) - 1 as int), {n_groups})"
    got = sums.select("i", F.expr(main).alias("g")).toArrow()
    out = np.full(size, n_groups, dtype=np.int64)
    out[got.column("i").to_numpy()] = got.column("g").to_numpy()
    return out


def head_classes(counts: np.ndarray, main: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Groups 0, 1, ... of the head words, and classes in each by frequency, of about equal mass."""
    group, level = np.unique(main, return_inverse=True)[1], np.zeros(len(counts), dtype=np.int64)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        mass = np.cumsum(counts[at])
        level[at] = np.minimum(levels - 1, (mass - counts[at]) * levels // max(1, mass[-1]))
    return group, level


@dataclass
class Model:
    """size: head words. By event (head words, tail: size, end: size + 1): group, level (class in the group),
    inner: log10 within the class by counts alone; nodes and branches (events, depth) on the way to a word
    (-1: none). Weights of groups (rows, groups) and, by slot, of levels and branches (rows * slots, levels): the
    first slots are the groups, the others those of nodes. Every position has the bias of groups, that of levels
    by group (-1e9: no such class) and that of branches by node, from counts."""

    size: int
    group: np.ndarray
    level: np.ndarray
    inner: np.ndarray
    base: np.ndarray
    bias: np.ndarray
    level_bias: np.ndarray
    weights: np.ndarray
    level_weights: np.ndarray
    trained: bool = True
    nodes: np.ndarray | None = None
    branches: np.ndarray | None = None
    node_bias: np.ndarray | None = None

    @property
    def slots(self) -> int:
        return len(self.level_weights) // self.rows

    @property
    def groups(self) -> int:
        return len(self.bias)

    @property
    def rows(self) -> int:
        return len(self.weights)


def with_ends(flat: np.ndarray, per: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences with the end event after each, and each position's place in its sequence."""
    y, n = np.insert(flat, np.cumsum(per), end), per + 1
    return y, np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n)


def features(y: np.ndarray, place: np.ndarray, start: int, rows: int) -> list[np.ndarray]:
    """Hashed features of every position (rows of the weights): each sees only what comes before in its sequence."""
    p = []
    for k in range(1, CONTEXT + 1):
        w = np.empty(len(y), dtype=np.uint64)
        w[:k], w[k:] = start, y[:-k] if k < len(y) else y[:0]
        w[place < k] = start
        p.append(w + np.uint64(1))
    shift = np.uint64(64 - (rows.bit_length() - 1))
    keys = [p[0] * _K[0], p[0] * _K[1] + p[1] * _K[2], p[1] * _K[3], p[2] * _K[4], p[3] * _K[5]]
    return [((k ^ (k >> np.uint64(29))) * _K[0] >> shift).astype(np.int64) for k in keys]


def _softmax(z: np.ndarray) -> np.ndarray:
    # Rows are short, so a product sums them faster than a reduction, and bounds stand for their maxima.
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], dtype=z.dtype))[:, None]
    return z


def chances(m: Model, feats: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position: chances of all groups, and of all levels of the given group."""
    z, v = np.tile(m.bias, (len(group), 1)), m.level_bias.take(group, axis=0)
    for f in feats:
        z += m.weights.take(f, axis=0)
        v += m.level_weights.take(f * m.slots + group, axis=0)
    return _softmax(z), _softmax(v)


def word_paths(counts: np.ndarray, cls: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and branches (words, depth; -1: none) from the class of each word down to it, and the log share of
    each node's branches (-1e9: no such branch). Counts descend; a branch has about 1 / width of its node's mass."""
    n, n_nodes = len(counts), 0
    order = np.argsort(cls, kind="stable")
    c, key = counts[order] + SMOOTH, cls[order]
    nodes, branches, bias = [], [], []
    while n:
        starts = _runs(key)
        sizes = np.diff(np.append(starts, n))
        if sizes.max() == 1:
            break
        seg, total, before = np.repeat(np.arange(len(starts)), sizes), np.add.reduceat(c, starts), np.cumsum(c) - c
        before -= before[starts][seg]
        b = np.minimum(width - 1, (before * width / total[seg]).astype(np.int64))
        b[starts + sizes - 1] = width - 1
        b = np.where((sizes <= width)[seg], np.arange(n) - starts[seg], b)
        node = np.where((sizes > 1)[seg], (np.cumsum(sizes > 1) - 1)[seg] + n_nodes, -1)
        some = node >= 0
        mass = np.bincount((node[some] - n_nodes) * width + b[some], weights=c[some], minlength=int((sizes > 1).sum()) * width).reshape(-1, width)
        bias.append(np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum(axis=1, keepdims=True)), -1e9))
        n_nodes += len(mass)
        nodes.append(node)
        branches.append(np.where(some, b, -1))
        key = seg * width + b
    back = np.argsort(order, kind="stable")
    table = lambda x, kind: np.stack(x, axis=1)[back].astype(kind) if x else np.zeros((n, 0), dtype=kind)
    return table(nodes, np.int32), table(branches, np.int8), np.concatenate(bias or [np.zeros((0, width))]).astype(np.float32)


def branch_chances(m: Model, feats: list[np.ndarray], y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By depth: positions whose word is further down, their slots, the branch to take, and all branches' chances."""
    at = np.arange(len(y))
    for depth in range(0 if m.nodes is None else m.nodes.shape[1]):
        node = m.nodes[y[at], depth]
        at, node = at[node >= 0], node[node >= 0]
        if not len(at):
            return
        slot = m.groups + node % (m.slots - m.groups)
        z = m.node_bias.take(node, axis=0)
        for f in feats:
            z += m.level_weights.take(f[at] * m.slots + slot, axis=0)
        yield at, slot, m.branches[y[at], depth], _softmax(z)


def log_chances(m: Model, feats: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log10 of the chance of each position's event; in the tail, of the tail class."""
    at, group = np.arange(len(y)), m.group[y]
    p, v = chances(m, feats, group)
    out = np.log10(p[at, group].astype(np.float64)) + np.log10(v[at, m.level[y]])
    if m.nodes is None:
        return out + m.inner[y]
    for some, _, b, d in branch_chances(m, feats, y):
        out[some] += np.log10(d[np.arange(len(some)), b])
    return out


class Learner:
    """Adaptive gradient steps on the log loss of batches, over weights of its own."""

    def __init__(self, m: Model, step: float):
        self.m = Model(
            m.size, m.group, m.level, m.inner, m.base, m.bias.copy(), m.level_bias.copy(), m.weights.copy(), m.level_weights.copy(), m.trained, m.nodes, m.branches, m.node_bias
        )
        self.step = step
        self.squares = [np.full_like(w, 1e-2) for w in self._all()]
        self.seen, self.n = np.zeros(m.rows, dtype=np.int64), 0

    def _all(self) -> list[np.ndarray]:
        return [self.m.bias, self.m.level_bias, self.m.weights, self.m.level_weights]

    def learn(self, feats: list[np.ndarray], y: np.ndarray) -> None:
        m = self.m
        group, level = m.group[y], m.level[y]
        e, d = chances(m, feats, group)
        e[np.arange(len(y)), group] -= 1
        # Groups of one class have nothing to learn within.
        some = np.flatnonzero((m.level_bias > -1e8).sum(axis=1)[group] > 1)
        d = d[some]
        d[np.arange(len(some)), level[some]] -= 1
        at = np.concatenate(feats)
        deep, down = [np.concatenate([f[some] * m.slots + group[some] for f in feats])], [np.tile(d, (len(feats), 1))]
        for further, slot, branch, b in branch_chances(m, feats, y):
            b[np.arange(len(further)), branch] -= 1
            deep.append(np.concatenate([f[further] * m.slots + slot for f in feats]))
            down.append(np.tile(b, (len(feats), 1)))
        deep, down = np.concatenate(deep), np.concatenate(down)
        grads = [np.zeros_like(w) for w in self._all()]
        for c, col in enumerate(e.T.astype(np.float64)):
            grads[0][c] = col.sum()
            grads[2][:, c] = np.bincount(at, weights=np.tile(col, len(feats)), minlength=m.rows)
        for c, col in enumerate(d.T.astype(np.float64)):
            grads[1][:, c] = np.bincount(group[some], weights=col, minlength=m.groups)
        for c in range(down.shape[1]):
            grads[3][:, c] = np.bincount(deep, weights=down[:, c], minlength=len(m.level_weights))
        for w, q, g in zip(self._all(), self.squares, grads):
            q += g * g
            g *= self.step
            g /= np.sqrt(q)
            w -= g
        self.seen += np.bincount(at, minlength=m.rows)
        self.n += len(y)


def train_round(coded: DataFrame, model: Model, step: float) -> Model:
    """The model after one round of distributed updates over all positions of all training rows."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    rows, groups, levels, slots = model.rows, model.groups, model.level_bias.shape[1], model.slots
    chunk = min(CHUNK, rows)
    schema = "k long, n binary, d binary"

    def batch_of(out: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, *_ in out], pa.int64()), pa.array([n for _, n, _ in out], pa.binary()), pa.array([d for *_, d in out], pa.binary())],
            names=["k", "n", "d"],
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        own, held, n = Learner(m, step), [], 0

        def step_over() -> None:
            fs = [np.concatenate(f) for f in zip(*(f for f, _ in held))]
            y = np.concatenate([y for _, y in held])
            # Equal parts, so that no step rests on a few positions.
            for part in np.array_split(np.arange(len(y)), max(1, round(len(y) / BATCH))):
                a, b = part[0], part[-1] + 1
                own.learn([f[a:b] for f in fs], y[a:b])
            held.clear()

        for _, flat, per in _sequences(batches):
            y, place = with_ends(flat, per, m.size + 1)
            if len(y):
                held.append((features(y, place, m.size + 2, rows), y))
                n += len(y)
            if n >= BATCH:
                step_over()
                n = 0
        if n:
            step_over()
        if not own.n:
            return
        # The first row has what every position shares.
        flat = np.concatenate([own.m.bias - m.bias, (own.m.level_bias - m.level_bias).ravel()])
        yield batch_of([(-1, np.array([own.n]).tobytes(), flat.astype("<f2").tobytes())])
        delta = np.concatenate([own.m.weights - m.weights, (own.m.level_weights - m.level_weights).reshape(rows, slots * levels)], axis=1)
        for a in range(0, rows, 64 * chunk):
            ks = range(a, min(rows, a + 64 * chunk), chunk)
            yield batch_of(
                [(k // chunk, own.seen[k : k + chunk].tobytes(), delta[k : k + chunk].astype("<f2").tobytes()) for k in ks if own.seen[k : k + chunk].any()]
            )
        del own, delta
        release()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, n, d in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "d"))):
                n = np.frombuffer(n, dtype=np.int64)
                d = np.frombuffer(d, dtype="<f2").reshape(len(n), -1).astype(np.float64) * n[:, None]
                if k in total:
                    total[k][0] = total[k][0] + n
                    total[k][1] += d
                else:
                    total[k] = [n, d]
        if total:
            yield batch_of([(k, n.tobytes(), (d / np.maximum(n, 1)[:, None]).astype("<f4").tobytes()) for k, (n, d) in total.items()])

    got = coded.filter("train").select("seq").mapInArrow(learn, schema).repartition("k").mapInArrow(average, schema).select("k", "d").toArrow()
    bias, level_bias = model.bias.copy(), model.level_bias.copy()
    weights, deep = model.weights.copy(), model.level_weights.copy().reshape(rows, slots * levels)
    for k, d in zip(got.column("k").to_pylist(), got.column("d").to_pylist()):
        d = np.frombuffer(d, dtype="<f4")
        if k < 0:
            bias += d[:groups]
            level_bias += d[groups:].reshape(groups, levels)
        else:
            d = d.reshape(-1, groups + slots * levels)
            weights[k * chunk : (k + 1) * chunk] += d[:, :groups]
            deep[k * chunk : (k + 1) * chunk] += d[:, groups:]
    return Model(
        model.size, model.group, model.level, model.inner, model.base, bias, level_bias, weights, deep.reshape(-1, levels), model.trained,
        model.nodes, model.branches, model.node_bias,
    )


def tail_chances(words: dict[int, int], mass: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For tail words by band of their count: chance of the band (0: unseen words), and words in the band.

    ``words`` counts words by the band of their count, ``mass`` their occurrences by the band that the count
    would have without one of the word's documents: those stand for the occurrences of such words elsewhere.
    """
    n_bands = max([0, *words, *mass]) + 1
    n = np.array([words.get(b, 0) for b in range(n_bands)], dtype=np.int64)
    m = np.array([mass.get(b, 0) for b in range(n_bands)], dtype=float)
    some = (n > 0) | (np.arange(n_bands) == 0)
    q = np.where(some, m + 0.5, 0.0)
    # Mass of bands that hold no word goes to the unseen.
    q[0] += m[~some].sum()
    return q / q.sum(), n


def score(docs: DataFrame, head_share: float = HEAD_SHARE, head_count: int = HEAD_COUNT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``docs`` has doc_id and text (others are ignored). Rows whose crc32(doc_id) is divisible by 10 are
    held out, rows with a null doc_id too. Null texts are empty and have the end token alone. Scores are
    log10; base_score is the add-0.1 unigram's. Without training rows both rest on smoothing alone; an
    empty table gives no rows. Words are told apart by 63-bit hashes. Repeated rows score alike.
    """
    spark = docs.sparkSession
    train = docs.filter(is_training())
    counts = materialise(word_counts(train), "counts")
    n_docs = train.count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_tokens = (total["n"] or 0) + n_docs
    z = n_tokens + SMOOTH * (total["v"] + (n_docs > 0) + 1)
    least = max(head_count, int(np.ceil(n_tokens * head_share)))
    top = counts.filter(F.col("c") >= least).orderBy(F.desc("c"), "h").select("h", "c").toArrow()
    head, head_c = top.column("h").to_numpy(), top.column("c").to_numpy()
    coded = materialise(encode(docs, head), "coded")

    tail = counts.filter(F.col("c") < least)
    rest = "if(df <= 1, 0L, c - cast(round(c / df) as bigint))"
    bands = (
        tail.select(F.expr(_band_sql("c")).alias("b"), F.lit(1).alias("w"), F.lit(0).alias("m"))
        .unionByName(tail.select(F.expr(_band_sql(rest)).alias("b"), F.lit(0).alias("w"), F.col("c").alias("m")))
        .groupBy("b")
        .agg(F.sum("w").alias("w"), F.sum("m").alias("m"))
        .collect()
    )
    q, band_words = tail_chances({r["b"]: r["w"] for r in bands if r["w"]}, {r["b"]: r["m"] for r in bands if r["m"]})

    model = start_model(coded.filter("train"), head_c, n_docs, sum(r["m"] for r in bands), z)
    for r in range(rounds if n_docs else 0):
        model = train_round(coded, model, STEP / (1 + r))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, flat, per in _sequences(batches):
            y, place = with_ends(flat, per, m.size + 1)
            lp = np.empty(len(y))
            feats = features(y, place, m.size + 2, m.rows)
            for k in range(0, len(y), BATCH):
                lp[k : k + BATCH] = log_chances(m, [f[k : k + BATCH] for f in feats], y[k : k + BATCH])
            first = np.cumsum(per + 1) - (per + 1)
            sums = [np.add.reduceat(x, first) if len(y) else x for x in (lp, m.base[y], (y != m.size).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("train"), batch.column("n"), pa.array(sums[2] - (not m.trained)), pa.array(sums[1]), pa.array(sums[0])],
                names=["rid", "doc_id", "train", "n", "known", "own", "lp"],
            )

    scored = coded.select("rid", "doc_id", "train", "n", "seq").mapInArrow(
        run, "rid long, doc_id long, train boolean, n long, known long, own double, lp double"
    )
    inner = "array(" + ", ".join(f"{v!r}D" for v in tail_inner(q, band_words).tolist()) + ")"
    rests = (
        coded.select("rid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t"))
        .select("rid", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("k"))
        .join(tail.select("h", "c").hint("shuffle_hash"), "h", "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("rid")
        .agg(
            F.sum(F.expr("if(c > 0, k, 0)")).alias("t_known"),
            F.sum(F.expr(f"k * log10((c + {SMOOTH}D) / {z!r}D)")).alias("t_own"),
            F.sum(F.expr(f"k * element_at({inner}, 1 + {_band_sql('c')})")).alias("t_lp"),
        )
    )
    zero = F.lit(0)
    return scored.join(rests, "rid", "left").select(
        "doc_id",
        F.expr("not train").alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("t_known", zero)).cast("long").alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("own") + F.coalesce("t_own", zero.cast("double"))).alias("base_score"),
        (F.col("lp") + F.coalesce("t_lp", zero.cast("double"))).alias("score"),
    )


def tail_inner(q: np.ndarray, band_words: np.ndarray) -> np.ndarray:
    """log10 of each tail word within the tail class, by the band of its count; unseen words are one event."""
    return np.log10(np.where(band_words > 0, q / np.maximum(band_words, 1), q[0]))


def start_model(coded: DataFrame, head_c: np.ndarray, n_docs: int, tail_mass: int, z: float) -> Model:
    """Classes, the tree of words in each, and weights of zero but for the bias: the shares by counts."""
    size = len(head_c)
    anchors = min(ANCHORS, size)
    if anchors:
        groups = anchor_groups(coded, anchors, GROUPS)
        n_groups = int(groups.max()) + 1
        group, level = head_classes(head_c, main_groups(coded, groups, n_groups, size))
    else:
        group, level = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    g = int(group.max(initial=-1)) + 1
    group, level = np.concatenate([group, [g, g + 1]]), np.concatenate([level, [0, 0]])
    levels = LEVELS
    mass = np.concatenate([head_c, [tail_mass, n_docs]]).astype(float)
    cls = group * levels + level
    by_class, words = np.bincount(cls, weights=mass, minlength=(g + 2) * levels), np.bincount(cls, minlength=(g + 2) * levels)
    inner, base = np.zeros(size + 2), np.full(size + 2, np.log10(SMOOTH / z))
    if size:
        inner[:size] = np.log10((head_c + SMOOTH) / (by_class[cls[:size]] + SMOOTH * words[cls[:size]]))
        base[:size] = np.log10((head_c + SMOOTH) / z)
    # The tail's part of both comes with its words' own counts.
    base[size], inner[size] = 0.0, 0.0
    base[size + 1] = np.log10((n_docs + SMOOTH) / z)
    share = by_class.reshape(g + 2, levels) + 0.5 * (words.reshape(g + 2, levels) > 0)
    level_bias = np.where(share > 0, np.log(np.maximum(share, 1e-9) / share.sum(axis=1, keepdims=True)), -1e9)
    nodes, branches, node_bias = word_paths(head_c, cls[:size], levels)
    none = np.full((2, nodes.shape[1]), -1)
    rows = LEAST_ROWS
    while rows * WORDS_PER_ROW < size:
        rows *= 2
    return Model(
        size,
        group,
        level,
        inner.astype(np.float32),
        base,
        np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
        level_bias.astype(np.float32),
        np.zeros((rows, g + 2), dtype=np.float32),
        np.zeros((rows * (g + 2 + SLOTS), levels), dtype=np.float32),
        n_docs > 0,
        np.concatenate([nodes, none.astype(np.int32)]),
        np.concatenate([branches, none.astype(np.int8)]),
        node_bias,
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
