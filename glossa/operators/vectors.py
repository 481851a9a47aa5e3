"""Nearest candidates by embedding, block by block: pairs are never rows of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, maybe_broadcast

#: Vectors of one cell (a block of queries against one of candidates), and pairs held as numbers at a time.
QUERY_BLOCK, CANDIDATE_BLOCK, PAIRS = 1 << 13, 1 << 16, 1 << 20
#: What rounding to six places and sums in another order can move a similarity, with room.
NEAR = 4e-6


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros behind shorter ones; the length of each, 0 where it or a part of it is null."""
    lists = column.cast(pa.list_(pa.float64())).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    hole = np.zeros(len(size), dtype=bool)
    hole[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return out, np.where(hole, 0, size)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first place to the last as an SQL fold does."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if len(a) else np.zeros(0)


def _wide(a: np.ndarray, n: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, n - a.shape[1])))


def _cell(queries: pa.Table, cands: pa.Table) -> pa.Table:
    """Of each query and set of one cell the candidates that may be its most similar, with exact cosines."""
    cands = cands.sort_by("set_key")
    key, idx = (t.column(c).to_numpy() for t, c in ((queries, "key"), (cands, "idx")))
    sets = cands.column("set_key").to_numpy()
    (q, nq), (c, nc) = _matrix(queries.column("q")), _matrix(cands.column("c"))
    wide = max(q.shape[1], c.shape[1])
    q, c = _wide(q, wide), _wide(c, wide)
    lq, lc = np.sqrt(_dot(q, q)), np.sqrt(_dot(c, c))
    found: list[tuple[np.ndarray, ...]] = []
    if len(idx) and len(key):
        first = np.flatnonzero(np.append(True, sets[1:] != sets[:-1]))
        each = np.diff(np.append(first, len(sets)))
        step = max(1, PAIRS // len(idx))
        alike = len(np.unique(np.concatenate([nq, nc]))) == 1 and nq[0] > 0
        with np.errstate(all="ignore"):
            for a in range(0, len(key), step):
                b = slice(a, a + step)
                below = lq[b, None] * lc
                sim = q[b] @ c.T / below
                # A cosine that is no number is the greatest, one that is missing the least.
                sim[np.isnan(sim)] = np.inf
                missing = below == 0
                if not alike:
                    missing |= (nq[b, None] != nc) | (nq[b, None] == 0)
                own = key[b, None] == idx
                sim[missing | own] = -np.inf
                most = np.maximum.reduceat(sim, first, axis=1)
                i, j = np.nonzero(sim >= np.repeat(most - NEAR, each, axis=1))
                there = ~own[i, j]
                i, j = i[there], j[there]
                exact = _dot(q[b][i], c[j]) / below[i, j]
                found.append((key[b][i], sets[j], idx[j], exact, missing[i, j]))
    cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=t) for t in ("i8", "i8", "i8", "f8", "?")]
    cosine = pa.array(cols[3], mask=cols[4])
    return pa.table({"key": pa.array(cols[0]), "set_key": pa.array(cols[1]), "idx": pa.array(cols[2]), "cosine": cosine})


def nearest_in_sets(queries: DataFrame, cands: DataFrame, by: str) -> DataFrame:
    """key, set_key, idx, similarity: of each query's sets the candidates of the highest cosine (six places), all ties.

    ``queries``: key, q and ``by``; ``cands``: idx, set_key, c and ``by``; keys are longs, vectors arrays. A query
    meets the candidates of its own group but itself. Groups are cut into blocks, each pair of blocks is one
    product of matrices, and only rows that may be the best of a query and set leave it: memory is bounded
    and work is spread.
    """
    bound_batches(queries.sparkSession)
    blocks = lambda df, size, name: df.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    cells = maybe_broadcast(blocks(queries, QUERY_BLOCK, "nq").join(blocks(cands, CANDIDATE_BLOCK, "nc"), by))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    q = queries.join(cells, by).select(F.col(by).alias("g"), own("key", "nq").alias("qb"), other("nc").alias("cb"), F.col("key").cast("long").alias("key"), "q")
    c = cands.join(cells, by).select(F.col(by).alias("g"), other("nq").alias("qb"), own("idx", "nc").alias("cb"), F.col("idx").cast("long").alias("idx"), F.col("set_key").cast("long").alias("set_key"), "c")
    cell = ["g", "qb", "cb"]
    near = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(_cell, "key long, set_key long, idx long, cosine double")
    near = near.withColumn("similarity", F.round("cosine", 6)).drop("cosine")
    best = near.groupBy("key", "set_key").agg(F.max("similarity").alias("similarity"), F.collect_list(F.struct("similarity", "idx")).alias("all"))
    same = F.filter("all", lambda x: x["similarity"].eqNullSafe(F.col("similarity")))
    return best.select("key", "set_key", F.explode(same).alias("x")).select("key", "set_key", "x.idx", "x.similarity")
