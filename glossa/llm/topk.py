"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components become integers. A block of vectors is indexed by posting segments: for each dimension, the
vectors whose component there has a quantised magnitude (its impact) in one range, with those components.
Queries visit segments by descending impact and add up products, many queries at a time. What they
haven't seen of a vector is bounded by Cauchy and Schwarz: the query's length times that of the vector's
unseen components. A query ends only when that proves all but a few vectors to be out of its top k; those
few are scored exactly from their rows. A segment with many postings is added up as one matrix product.

Vectors and queries meet in cells. Where there are many cells, a sample of the vectors is searched first:
its k-th best score bounds what the others must reach, so cells return little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, to_batch
from .jaccard import grouped

#: Vectors and queries of a cell at most; vectors of an index; cells of a table that allows smaller ones.
BLOCK, QUERIES, INDEX, CELLS = 131_072, 131_072, 16_384, 24
#: One vector in so many is searched first.
FIRST = 16
#: Share of a segment's components that are not 0 from which it is a matrix.
DENSE = 1 / 16
NO_BAR = -(2**63)
#: Shares of the vectors' energy that the segments down to each one hold.
ENERGY = (0.55, 0.8, 0.93, 0.99, 1.0)
LEVELS = 64
#: Queries that share a pass over a segment; a query is done when it needs so few exact scores (or this share of them).
TOGETHER, FEW, FEW_SHARE = 16, 2, 128


class ImpactIndex:
    """Vectors of one block with their postings by impact range and dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        size = np.abs(rows)
        self.top = int(size.max(initial=0))
        exact = rows.astype(np.float64)
        self.norm = float(np.sqrt((exact**2).sum(axis=1)).max(initial=0))
        # Sums below 2^24 are exact as 32-bit floats.
        self.kind = np.float32 if self.top**2 * max(1, rows.shape[1]) < 2**24 else np.float64
        level = size // max(1, -(-(self.top + 1) // LEVELS))
        energy = np.bincount(level.ravel(), weights=exact.ravel() ** 2, minlength=LEVELS)[::-1].cumsum()
        cuts = sorted({int(LEVELS - 1 - np.searchsorted(energy, e * energy[-1] * (1 - 1e-12))) for e in ENERGY[:-1]} | {0}, reverse=True)
        #: By segment: postings (dimension, vectors, components), and the length of what is unseen after it.
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.rest: list[np.ndarray] = []
        self.dense: list[np.ndarray | None] = []
        self._floats = rows.astype(np.float32) if self.kind is np.float32 else None
        #: Segments that queries have visited.
        self.visits = 0
        above = LEVELS
        for cut in cuts:
            part = (level >= cut) & (level < above) & (rows != 0)
            lists = []
            for d in range(rows.shape[1]):
                at = np.flatnonzero(part[:, d])
                if len(at):
                    lists.append((d, at.astype(np.int32), rows[at, d].astype(self.kind)))
            self.segments.append(lists)
            self.dense.append(np.where(part, rows, 0).astype(self.kind) if part.sum() >= DENSE * part.size else None)
            self.rest.append(np.sqrt(np.where(level < cut, exact**2, 0).sum(axis=1)))
            above = cut

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact integer scores; such beyond 63 bits raise OverflowError."""
        wide = float(np.abs(query).max(initial=0)) * self.top * max(1, len(query))
        if self._floats is not None and wide < 2**24:
            return (self._floats[at] @ query.astype(np.float32)).astype(np.int64)
        if wide < 2**62:
            return (self.rows[at] * query).sum(axis=1)
        return np.array((self.rows[at].astype(object) * query.astype(object)).sum(axis=1).tolist(), dtype=np.int64)

    def search(self, queries: np.ndarray, own: list[int | None], k: int, floors: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query (score, id) of the k best but its own id, best first, ties to the smaller id.

        Scores below the query's one of ``floors`` may be left out."""
        out, floors = [], np.full(len(queries), NO_BAR) if floors is None else floors
        for a in range(0, len(queries), TOGETHER):
            out += self._together(queries[a : a + TOGETHER], own[a : a + TOGETHER], k, floors[a : a + TOGETHER])
        return out

    def _together(self, queries: np.ndarray, own: list[int | None], k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        n, found = len(self.ids), [None] * len(queries)
        wide = float(np.abs(queries).max(initial=0)) * self.top * max(1, queries.shape[1])
        kind = self.kind if wide < 2**24 else np.float64
        q = queries.T.astype(kind)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        # Rounding of the sums and bounds.
        slack = 1e-5 * (1 + length * self.norm)
        few, bar = max(FEW * k, n // FEW_SHARE), np.where(floors > NO_BAR, floors, -np.inf)
        open_, acc = np.arange(len(queries)), np.zeros((n, len(queries)), dtype=kind)
        for s, (lists, dense, rest) in enumerate(zip(self.segments, self.dense, self.rest)):
            if dense is not None:
                acc += dense.astype(kind, copy=False) @ q[:, open_]
            for d, at, values in lists if dense is None else ():
                part = np.multiply.outer(values.astype(kind, copy=False), q[d, open_])
                part += acc.take(at, axis=0)
                acc[at] = part
            self.visits += len(open_)
            if s == 0 and n > k:
                # Exact scores of the best so far: no member of the top k is below their k-th.
                some = np.flatnonzero(bar[open_] == -np.inf)
                for j, own_acc in zip(open_[some], np.ascontiguousarray(acc[:, some].T)):
                    first = np.argpartition(own_acc, -min(n, 4 * k))[-min(n, 4 * k) :]
                    exact = self.scores(queries[j], first[self.ids[first] != own[j]] if own[j] is not None else first)
                    if len(exact) >= k:
                        bar[j] = np.partition(exact, len(exact) - k)[len(exact) - k]
            possible = np.multiply.outer(rest.astype(kind), length[open_].astype(kind))
            possible += acc
            possible = possible >= (bar[open_] - slack[open_]).astype(kind)
            ready = possible.sum(axis=0) <= few if s < len(self.segments) - 1 else np.ones(len(open_), dtype=bool)
            for i in np.flatnonzero(ready):
                j = open_[i]
                found[j] = self._best(queries[j], np.flatnonzero(possible[:, i]), k, own[j])
            if ready.all():
                break
            open_, acc = open_[~ready], acc[:, ~ready]
        return found

    def _best(self, query: np.ndarray, at: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        if own is not None:
            at = at[self.ids[at] != own]
        s, ids = self.scores(query, at), self.ids[at]
        if len(s) > 4 * k:
            bar = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= bar
            s, ids = s[keep], ids[keep]
        order = np.lexsort((ids, -s))[:k]
        return list(zip(s[order].tolist(), ids[order].tolist()))


def _integers(vectors: DataFrame, scale: float) -> DataFrame:
    """Distinct (vec_id, v): components as floor(scale * x), little-endian, after the bytes of one in one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = [], []
            for key, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                if key is None or not v or None in v:
                    continue
                x = np.floor(scale * np.array(v, dtype=np.float64))
                if np.isfinite(x).all():
                    if np.abs(x).max() >= 2.0**63:
                        raise OverflowError(f"vector {key}: a scaled component exceeds 63 bits")
                    ids.append(key)
                    raw.append(_pack(x.astype("<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    return vectors.mapInArrow(run, "vec_id long, v binary").distinct()


def _pack(x: np.ndarray) -> bytes:
    size = next(n for n in (1, 2, 4, 8) if n == 8 or (-(2 ** (8 * n - 1)) <= x.min() and x.max() < 2 ** (8 * n - 1)))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _width(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width), dtype=np.int64)
    for i, b in enumerate(raw):
        v = np.frombuffer(b, dtype=f"<i{b[0]}", offset=1)[:width]
        out[i, : len(v)] = v
    return out


def _cells(v: DataFrame, q: DataFrame, k: int, n_v: int, n_q: int) -> DataFrame:
    """query_id, vec_id, score of each cell's k best for each query, without those below its ``least``."""
    one = v.select("vec_id", "v", F.lit(False).alias("ask"), F.lit(None).cast("long").alias("least"), F.expr(f"cast(pmod(xxhash64(vec_id, 3), {n_v}) as int)").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("y"))
    two = q.select("vec_id", "v", F.lit(True).alias("ask"), "least", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("x"), F.expr(f"cast(pmod(xxhash64(vec_id, 4), {n_q}) as int)").alias("y"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(ids: np.ndarray, rows: np.ndarray, part: dict[str, list], found: list[list[tuple[int, int]]]) -> None:
        queries, own = _matrix(part["v"], rows.shape[1]), part["vec_id"]
        floors = np.array([NO_BAR if x is None else x for x in part["least"]], dtype=np.int64)
        for a in range(0, len(ids), INDEX):
            index = ImpactIndex(ids[a : a + INDEX], rows[a : a + INDEX])
            for j, hits in enumerate(index.search(queries, own, k, floors)):
                hits = [h for h in hits if h[0] >= floors[j]]
                if hits:
                    found[j] = sorted(found[j] + hits, key=lambda h: (-h[0], h[1]))[:k]
                    if len(found[j]) == k:
                        floors[j] = max(floors[j], found[j][-1][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, at = None, None, None
        for part in grouped(batches, ["x", "y", "ask"]):
            if not part["ask"][0]:
                ids, rows = np.array(part["vec_id"], dtype=np.int64), _matrix(part["v"], max(map(_width, part["v"])))
                at = (part["x"][0], part["y"][0])
            elif at == (part["x"][0], part["y"][0]):
                found: list[list[tuple[int, int]]] = [[] for _ in part["v"]]
                search(ids, rows, part, found)
                for a in range(0, len(found), 4096):
                    out = [(key, i, s) for key, hits in zip(part["vec_id"][a : a + 4096], found[a : a + 4096]) for s, i in hits]
                    if out:
                        yield to_batch(schema, zip(*out))

    return (
        one.unionByName(two)
        .repartition("x", "y")
        .sortWithinPartitions("x", "y", "ask")
        .mapInArrow(run, "query_id long, vec_id long, score long")
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    block: int = BLOCK,
    query_block: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query (vec_id, embedding) with
    the rows of ``vectors`` (vec_id, embedding) of another id; ties to the smaller id.

    Null ids, null or empty vectors and those with null or non-finite components take no part. Missing
    components of shorter vectors count as 0. Repeated rows count once; an id with several vectors is
    searched and found with each. Empty tables give no rows. Scaled components and scores beyond 63 bits
    raise an error instead of wrapping. Vectors and queries meet block by block.
    """
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")]
    v = materialise(_integers(vectors.select(*pick), scale), "vectors")
    q = materialise(_integers(queries.select(*pick), scale), "queries").withColumn("least", F.lit(None).cast("long"))
    n, m = v.count(), q.count()
    size = min(block, max(1, n // CELLS, INDEX // 4))
    n_v, n_q = max(1, -(-n // size)), max(1, -(-m // query_block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if n_v < 4:
        found = _cells(v, q, k, n_v, n_q)
    else:
        early = F.expr(f"pmod(xxhash64(vec_id, 5), {FIRST}) = 0")
        first = materialise(best(_cells(v.filter(early), q, k, -(-n_v // FIRST), n_q)), "first")
        least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        q = q.drop("least").join(least.hint("merge"), "vec_id", "left")
        found = first.drop("rank").unionByName(_cells(v.filter(~early), q, k, n_v, n_q))
    return best(found).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
