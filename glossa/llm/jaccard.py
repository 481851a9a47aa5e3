"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Texts are lower-cased runs of word characters; a document's set holds its word n-grams (a text of fewer
words has one gram of all its words). Documents with the same words are one copy class, and only one
representative of each class goes on, so copies cost nothing further. A band's bucket that many
representatives share is cut into blocks, and every pair of blocks is a cell of bounded size that some
task verifies; a pair is verified only in the first band that it shares, so nothing is counted twice.
Cells return, per member, its number of links and a spanning root: never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, WordHashes, materialise, mix64, read_table, release, rows, to_batch
from .graph import connected_components

#: Members of a block; a cell holds two blocks at most.
BLOCK = 256


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, with which at most ``max_hashes``
    hashes find a pair at the threshold with at least this probability."""
    best = None
    for r in range(1, max_hashes + 1):
        p = threshold**r
        b = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if b * r <= max_hashes:
            best = (b, r)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def gram_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of documents whose word hashes lie one after the other, and the grams of each."""
    ends = np.cumsum(counts)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = int(grams.sum())
    first = np.repeat((ends - counts) - (np.cumsum(grams) - grams), grams) + np.arange(total)
    last = np.repeat(ends, grams)
    h = np.zeros(total, dtype=np.uint64)
    pad = np.append(words, np.uint64(0))
    for k in range(n):
        at = first + k
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.where(at < last, pad[np.minimum(at, len(words))], np.uint64(k)))
    return h, grams


def signatures(docs: DataFrame, n: int, bands: int, rows_: int, seed: int = 7) -> DataFrame:
    """doc_id, set_key (null without words), bands (array of band hashes) for each row."""
    rng = np.random.default_rng(seed)
    mul = (rng.integers(0, 2**32, bands * rows_, dtype=np.uint32) | 1).tolist()
    add = rng.integers(0, 2**32, bands * rows_, dtype=np.uint32).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in rows(batches, 1_000_000):
            words = [WORD.findall(t.lower()) if t else [] for t in part["text"]]
            counts = np.array([len(w) for w in words])
            flat = cache.array([x for w in words for x in w])
            ends = np.cumsum(counts)
            keys = [
                xxhash.xxh3_128_digest(flat[e - c : e].tobytes()) if c else None for e, c in zip(ends, counts)
            ]
            grams, per = gram_hashes(flat, counts, n)
            has = per > 0
            starts = (np.cumsum(per) - per)[has]
            out = np.zeros((len(words), bands), dtype=np.uint64)
            if len(starts):
                low = (grams >> np.uint64(20)).astype(np.uint32)
                buf = np.empty_like(low)
                for b in range(bands):
                    key = np.full(len(starts), b + 1, dtype=np.uint64)
                    for k in range(b * rows_, (b + 1) * rows_):
                        np.multiply(low, np.uint32(mul[k]), out=buf)
                        np.add(buf, np.uint32(add[k]), out=buf)
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(buf, starts))
                    out[has, b] = key
            offsets = np.cumsum(np.append(0, np.where(has, bands, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(out[has].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["doc_id"], pa.int64()), pa.array(keys, pa.binary()), lists], schema=schema
            )
            release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, set_key binary, bands array<long>"
    )


def _cells(members: DataFrame, block: int) -> DataFrame:
    """Members (bucket, size, node, ...) once for each cell of their bucket: adds x, y and blk."""
    nb = F.ceil(F.col("size") / F.lit(block)).cast("int")
    return (
        members.withColumn("nb", nb)
        .withColumn("blk", F.expr("cast(pmod(xxhash64(node, 17), nb) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .withColumn("x", F.least("blk", "other"))
        .withColumn("y", F.greatest("blk", "other"))
        .drop("other", "nb")
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: dict[str, list] | None = None
    last = None
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        at = list(zip(*(cols[k] for k in keys)))
        cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)] if at else [0]
        for a, b in zip(cuts, cuts[1:]):
            part = {n: v[a:b] for n, v in cols.items()}
            if held is not None and at[a] == last:
                held = {n: held[n] + part[n] for n in held}
            else:
                if held is not None:
                    yield held
                held = part
            last = at[a]
    if held is not None:
        yield held


class _Sets:
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        self.n, self.cache = n, WordHashes()

    def of(self, text: str) -> np.ndarray:
        w = self.cache.array(WORD.findall(text.lower()))
        return np.unique(gram_hashes(w, np.array([len(w)]), self.n)[0])


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def links(docs: DataFrame, reps: DataFrame, threshold: float, n: int, block: int = BLOCK) -> DataFrame:
    """node, n_links, root per cell and linked representative; ``reps`` has node and bands.

    All sides of its joins grow with the corpus, so they are merged at every size and never broadcast.
    """
    spread = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = (
        spread.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.min("band").alias("band"), F.expr("bit_xor(xxhash64(node))").alias("what"))
        .filter("size > 1")
        # Bands whose buckets hold the same members find the same pairs: the first band keeps them.
        .groupBy("size", "what")
        .agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select("b.band", "b.bucket", "size")
    )
    members = materialise(
        reps.select("node", F.explode("bands").alias("bucket")).join(buckets.hint("merge"), "bucket"), "members"
    )
    cells = (
        _cells(members, block)
        .join(reps.select("node", "bands").hint("merge"), "node")
        .join(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).hint("merge"), "node")
        .repartition("bucket", "x", "y")
        .sortWithinPartitions("bucket", "x", "y")
    )
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(n)
        out: list[tuple[int, int, int]] = []
        for cell in grouped(batches, ["bucket", "x", "y"]):
            out += verify(cell, sets)
            if len(out) > 5000:
                yield to_batch(schema, zip(*out))
                out = []
                release()
        if out:
            yield to_batch(schema, zip(*out))

    def verify(cell: dict[str, list], sets: _Sets) -> list[tuple[int, int, int]]:
        nodes, m = cell["node"], len(cell["node"])
        if m < 2:
            return []
        bands = np.array(cell["bands"], dtype=np.int64)
        blk, band, across = np.array(cell["blk"]), cell["band"][0], cell["x"][0] != cell["y"][0]
        got: list[np.ndarray | None] = [None] * m
        parent, degree = list(range(m)), [0] * m

        def grams(i: int) -> np.ndarray:
            if got[i] is None:
                got[i] = sets.of(cell["text"][i])
            return got[i]

        for i in range(m - 1):
            later = np.arange(i + 1, m)
            ok = (bands[later, :band] != bands[i, :band]).all(axis=1)
            if across:
                ok &= blk[later] != blk[i]
            later = later[ok]
            if not len(later):
                continue
            a = grams(i)
            others = [grams(j) for j in later]
            sizes = np.array([len(o) for o in others])
            # A set of another size than this can't reach the threshold.
            near = np.minimum(sizes, len(a)) >= threshold * np.maximum(sizes, len(a))
            for j, o in ((j, o) for j, o, k in zip(later, others, near) if k):
                pos = np.searchsorted(a, o)
                pos[pos == len(a)] = 0
                same = int((a[pos] == o).sum())
                if nodes[j] != nodes[i] and same >= threshold * (len(a) + len(o) - same):
                    degree[i] += 1
                    degree[j] += 1
                    ri, rj = _root(parent, i), _root(parent, int(j))
                    if ri != rj:
                        lo, hi = (ri, rj) if nodes[ri] < nodes[rj] else (rj, ri)
                        parent[hi] = lo
        return [(nodes[i], degree[i], nodes[_root(parent, i)]) for i in range(m) if degree[i]]

    return cells.select("bucket", "x", "y", "node", "blk", "band", "bands", "text").mapInArrow(
        run, "node long, n_links long, root long"
    )


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.55,
    n: int = 2,
    recall: float = 0.95,
    max_hashes: int = 128,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, class_id, n_links, copy_id, n_copies for each row of ``docs`` (doc_id, text; others ignored).

    copy_id is the least doc_id with the same words, n_copies their number; n_links counts the other
    copy classes whose sets reach the threshold; class_id is the least doc_id of those that links join.
    ``recall`` is the chance that bands meet for a pair exactly at the threshold; more similar pairs meet
    more surely. Null, empty and wordless texts and rows with a null doc_id stand alone, without links
    (class_id and copy_id are their doc_id). Repeated rows are copies; rows that repeat a doc_id with
    other words are one document with several sets. An empty table gives no rows.
    """
    bands, rows_ = choose_bands(threshold, recall, max_hashes)
    sig = materialise(signatures(docs, n, bands, rows_), "signatures")
    live = sig.filter("set_key is not null and doc_id is not null")
    classes = materialise(
        live.groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.count("*").alias("n_copies"), F.any_value("bands").alias("bands")
        ),
        "classes",
    )
    found = materialise(links(docs, classes.select("node", "bands"), threshold, n, block), "links")
    degree = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    table = (
        classes.select("set_key", "node", "n_copies")
        .join(degree, "node", "left")
        .join(roots, "node", "left")
        .select(
            "set_key",
            F.coalesce("root", "node").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.col("node").alias("copy_id"),
            "n_copies",
        )
    )
    placed = live.select("doc_id", "set_key").join(table, "set_key").drop("set_key")
    alone = sig.filter("set_key is null or doc_id is null").select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("copy_id"),
        F.lit(1).cast("long").alias("n_copies"),
    )
    return placed.unionByName(alone)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates: the one of least doc_id.

    Of rows that repeat that doc_id one stays. Rows with a null doc_id and wordless texts all stay.
    """
    groups = materialise(near_duplicates(docs, **options), "groups")
    gone = groups.filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    names = docs.columns
    kept = docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    again = groups.filter("doc_id = class_id and n_copies > 1").groupBy("doc_id").count().filter("count > 1")
    if again.limit(1).count() == 0:
        return kept.select(names)
    w = F.row_number().over(_by_id())
    twice = again.select(F.col("doc_id").alias("__twice"))
    single = kept.join(twice, F.col("doc_id").cast("long") == F.col("__twice"), "left_anti").select(names)
    one = kept.join(twice, F.col("doc_id").cast("long") == F.col("__twice")).withColumn("__n", w).filter("__n = 1")
    return single.unionByName(one.select(names))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("__twice").orderBy(F.col("text").asc_nulls_last())


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
