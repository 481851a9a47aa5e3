"""SimHash fingerprints, and all pairs of them within a Hamming radius by permuted block tables.

Terms are word n-grams; each votes on every bit with 1 + ln(frequency), by the bits of its hash. Texts
without words have the fingerprint of a term of their own characters, so equal texts always agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, WordHashes, materialise, mix64, read_table, slices, to_batch
from .jaccard import gram_hashes, grouped

BITS = 64


def _votes(grams: np.ndarray) -> np.ndarray:
    """Signed weights of each bit over the distinct grams of one text."""
    terms, counts = np.unique(grams, return_counts=True)
    bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w = 1 + np.log(counts)
    return 2 * (w @ bits) - w.sum()


class Fingerprinter:
    """64-bit fingerprints of texts; bit i is set where the votes on it sum above zero."""

    def __init__(self, n: int = 2):
        self.n, self.cache = n, WordHashes()

    def of(self, text: str) -> int:
        words = WORD.findall(text.lower())
        if not words:
            return xxhash.xxh3_64_intdigest(text)
        h = self.cache.array(words)
        votes = _votes(gram_hashes(h, np.array([len(h)]), self.n)[0])
        return int(np.packbits(votes > 1e-9, bitorder="little").view(np.uint64)[0])


def likeness(a: int, b: int) -> float:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the following one."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id, z (text, zstd), bucket and tail: rows of ascending buckets, each followed by its successor.

    Buckets are ranges of doc_id, from approximate quantiles; the first row of a bucket comes again at the
    end of the one before it (the first of all after the last), so each bucket can be read alone, in order.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    probs = [i / partitions for i in range(1, partitions)]
    cuts = ids.filter("doc_id is not null").approxQuantile("doc_id", probs, 0.25 / partitions) if probs else []
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    def buckets(keys: pa.Array) -> np.ndarray:
        own = np.searchsorted(bounds, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, own)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int | None] = {}
        for batch in slices(batches):
            for b, k in zip(buckets(batch.column("doc_id")).tolist(), batch.column("doc_id").to_pylist()):
                least[b] = k if k is None else min(k, least.get(b, k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], names=["b", "k"]
        )

    seen = ids.mapInArrow(firsts, "b int, k long").groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()
    prior = {r["k"]: seen[i - 1]["b"] for i, r in enumerate(seen)}

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            keys = batch.column("doc_id")
            raw = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            own = buckets(keys).tolist()
            again = [i for i, k in enumerate(keys.to_pylist()) if k in prior]
            at = [*range(len(raw)), *again]
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(at, pa.int32())),
                    pa.array([raw[i] for i in at], pa.binary()),
                    pa.array([*own, *(prior[keys[i].as_py()] for i in again)], pa.int32()),
                    pa.array([False] * len(raw) + [True] * len(again), pa.bool_()),
                ],
                names=["doc_id", "z", "bucket", "tail"],
            )

    return (
        docs.mapInArrow(squeeze, "doc_id long, z binary, bucket int, tail boolean")
        .repartitionById(len(bounds) + 2, F.col("bucket"))
        .sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "z")
    )


def fingerprints(docs: DataFrame, n: int = 2, partitions: int | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): fingerprints of its text and of its edited text.

    The next document follows by ascending doc_id (null last; equal ids in a fixed order), and the first follows
    the last; a single document is its own next. Null texts count as empty; an empty text is edited to an
    empty one. Equal texts have equal fingerprints. An empty table gives no rows.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, f = zstandard.ZstdDecompressor(), Fingerprinter(n)
        held: tuple[int | None, str, int] | None = None
        bucket = None
        out = []
        for batch in slices(batches):
            for key, raw, b, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "bucket", "tail"))):
                text = z.decompress(raw).decode()
                own = f.of(text)
                if b != bucket:
                    held, bucket = None, b
                if held is not None:
                    changed = edited(held[1], text)
                    fe = f.of(changed)
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    out.append(
                        (held[0], len(held[1]), sha, f"{held[2]:016x}", f"{fe:016x}", likeness(held[2], fe), likeness(held[2], own))
                    )
                held = None if tail else (key, text, own)
                if len(out) >= 2000:
                    yield to_batch(schema, zip(*out))
                    out = []
        if out:
            yield to_batch(schema, zip(*out))

    return with_next(lean, partitions).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks, one per table: each keeps blocks - radius of the blocks that the bits are cut into.

    Fingerprints that differ in at most ``radius`` bits differ in at most as many blocks, so they agree
    under at least one mask.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 64")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 6, block: int = 1024) -> DataFrame:
    """fingerprint, n_docs, n_near for each distinct value of ``prints`` (fingerprint, 16 hex digits).

    n_docs counts its rows, n_near the other fingerprints within the Hamming radius: all of them. Tables
    of masked fingerprints are grouped; a crowded group is cut into blocks, each pair of which is a cell
    of bounded size, and a pair counts in the first table in which it meets. Null fingerprints are left
    out; an empty table gives no rows. The joins are merged at every size and never broadcast: a row in the
    tables counts once per mask, which size estimates don't see.
    """
    masks = np.array(block_masks(radius, blocks), dtype=np.uint64)
    distinct = materialise(
        prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n_docs")), "prints"
    )
    signed = masks.view(np.int64).tolist()
    # Two halves, since a 16-digit number may exceed a signed long.
    node = F.expr(
        "shiftleft(cast(conv(substr(fingerprint, 1, 8), 16, 10) as bigint), 32)"
        " | cast(conv(substr(fingerprint, 9, 8), 16, 10) as bigint)"
    )
    nodes = distinct.select(node.alias("node"))
    table = F.expr("explode(array(" + ", ".join(f"struct({i} as t, xxhash64({i}, node & {m}L) as bucket)" for i, m in enumerate(signed)) + "))")
    spread = nodes.withColumn("s", table).select("node", "s.t", "s.bucket")
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    nb = F.ceil(F.col("size") / F.lit(block)).cast("int")
    cells = (
        spread.join(sizes.hint("merge"), "bucket")
        .withColumn("nb", nb)
        .withColumn("blk", F.expr("cast(pmod(xxhash64(node, 23), nb) as int)"))
        .withColumn("other", F.expr("explode(sequence(0, nb - 1))"))
        .select("bucket", "t", "node", "blk", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"))
        .repartition("bucket", "x", "y")
        .sortWithinPartitions("bucket", "x", "y")
    )
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for cell in grouped(batches, ["bucket", "x", "y"]):
            t = cell["t"][0]
            v = np.array(cell["node"], dtype=np.int64).view(np.uint64)
            blk, across = np.array(cell["blk"]), cell["x"][0] != cell["y"][0]
            degree = np.zeros(len(v), dtype=np.int64)
            for i in range(len(v) - 1):
                diff = v[i + 1 :] ^ v[i]
                ok = np.bitwise_count(diff) <= radius
                if across:
                    ok &= blk[i + 1 :] != blk[i]
                if ok.any():
                    ok &= ((diff[:, None] & masks[:t]) != 0).all(axis=1)
                    degree[i] += ok.sum()
                    degree[i + 1 :] += ok
            at = np.flatnonzero(degree)
            out += zip(v.view(np.int64)[at].tolist(), degree[at].tolist())
            if len(out) > 5000:
                yield to_batch(schema, zip(*out))
                out = []
        if out:
            yield to_batch(schema, zip(*out))

    found = cells.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_near"))
    return (
        distinct.withColumn("node", node)
        .join(found.hint("merge"), "node", "left")
        .select("fingerprint", "n_docs", F.coalesce("n_near", F.lit(0)).alias("n_near"))
    )


def with_near(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """The rows of ``prints`` (fingerprint, any others) with n_docs and n_near of their fingerprints."""
    kept = materialise(prints, "fingerprints")
    return kept.join(near_fingerprints(kept, radius, blocks).hint("merge"), "fingerprint", "left").select(*kept.columns, "n_docs", "n_near")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near(fingerprints(read_table(spark, sf_dir, "documents")))
