"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Target shares follow the sources' weights, but no source goes beyond ``max_repeats`` times its size;
what is above is shared out again by weight. Blocks go to sources, and within a source to its shards,
by highest quotients. A shard takes whole passes over its documents first; the blocks that remain are
chosen by a seeded permutation of the shard's blocks, which lie along its documents in seeded order.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, slices

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents of a shard, about: what one task sorts. One row per shard comes to the driver.
SHARD_DOCS = 20_000
#: One row per source comes to the driver; more sources than this are refused.
MAX_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int = 3) -> list[float]:
    """Targets that sum to the sizes' sum, in proportion to the weights, none above its cap."""
    n, total = len(sizes), sum(sizes)
    out: list[Fraction | None] = [None] * n
    w = [Fraction(x) for x in weights]
    caps = [Fraction(max_repeats * s) for s in sizes]
    open_, left = [i for i in range(n)], Fraction(total)
    while open_:
        mass = sum(w[i] for i in open_)
        if not mass:
            for i in open_:
                out[i] = Fraction(0)
            break
        over = [i for i in open_ if left * w[i] / mass > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / mass
            break
        for i in over:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if out[i] is None]
    return [float(x) for x in out]


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), never above the caps; ties to the earlier.

    All quotients above a divisor found by bisection are granted at once, the last seats one by one.
    """
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    v, cap = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)

    def won(d: float) -> np.ndarray:
        # quotients v / (2k + 1) >= d, for k = 0, 1, ...
        return np.minimum(np.floor((v / d + 1) / 2).clip(0, 2.0**52).astype(np.int64), cap)

    lo, hi = float(v[v > 0].min()) / (4 * seats + 4), float(v.max()) * 2
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if mid in (lo, hi):
            break
        if won(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    out = won(hi)
    while out.sum() < seats:
        q = np.where(out < cap, v / (2 * out + 1), -1.0)
        out[int(np.argmax(q))] += 1
    return out.tolist()


def _rule(seed: int, source: str | None, shard: int, blocks: int) -> tuple[int, int]:
    """A seeded affine permutation i -> (a * i + c) mod blocks."""
    h = int.from_bytes(hashlib.sha256(f"{seed}|{source!r}|{shard}".encode()).digest()[:16], "big")
    if blocks < 3:
        return 1, h % max(1, blocks)
    a = 1 + h % (blocks - 1)
    while math.gcd(a, blocks) != 1:
        a = a % (blocks - 1) + 1
    return a, (h >> 64) % blocks


def plan(
    spark: SparkSession,
    shards: list[tuple[str | None, int, int]],
    weight_of: Sequence[int],
    max_repeats: int,
    seed: int,
    max_block: int,
) -> tuple[DataFrame, int]:
    """One row per (source, shard): its target, passes and chosen blocks; and the block's tokens."""
    names = sorted({s for s, *_ in shards}, key=lambda s: (s is None, s or ""))
    size = {s: 0 for s in names}
    for s, _, n in shards:
        size[s] += n
    sizes = [size[s] for s in names]
    goal = targets(sizes, [weight_of[i % len(weight_of)] for i in range(len(names))], max_repeats)
    least = min((t for t in goal if t > 0), default=0)
    block = int(max(1, min(max_block, least // 1000)))
    parts = {s: [(k, n) for t, k, n in shards if t == s and n > 0] for s in names}
    blocks = {s: [-(-n // block) for _, n in parts[s]] for s in names}
    quota = sainte_lague(goal, round(sum(goal) / block), [max_repeats * sum(blocks[s]) for s in names])
    out = []
    for s, g, q in zip(names, goal, quota):
        own = sainte_lague([n for _, n in parts[s]], q, [max_repeats * b for b in blocks[s]])
        seen = set()
        for (k, n), b, mine in zip(parts[s], blocks[s], own):
            passes, rest = divmod(mine, b)
            a, c = _rule(seed, s, k, b)
            out.append((s, k, size[s], g, passes, rest, b, a, c))
            seen.add(k)
        out += [(s, k, size[s], g, 0, 0, 1, 1, 0) for t, k, n in shards if t == s and k not in seen]
    schema = "m_source string, m_shard int, source_size long, target double, passes long, rest long, blocks long, a long, c long"
    return spark.createDataFrame(out, schema), block


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_size, the words of each text (null: 0)."""
    return docs.withColumn(
        "mix_size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    )


def quotas(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 20,
    max_block: int = 1024,
    shard_docs: int = SHARD_DOCS,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, mix_size, any others) with what the mix takes of each.

    Adds mix_source_size and mix_target (of the source), mix_passes (whole copies taken), mix_ranges
    (array of [start, stop) words taken besides) and mix_taken (their words in all). Sources are ordered
    by code point, null last, and given the weights in turn. Texts without words take nothing; repeated
    rows count as often as they occur; a null doc_id is an id like any other; an empty table gives no
    rows. ``stats`` may hold the same rows without their wide columns.
    """
    spark = docs.sparkSession
    lean = (docs if stats is None else stats).select("doc_id", F.col("source").cast("string"), "mix_size")
    by_source = lean.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = spark.createDataFrame(
        [(r["source"], -(-r["n"] // shard_docs)) for r in by_source], "mix_key string, mix_shards long"
    )

    def sharded(df: DataFrame) -> DataFrame:
        key = F.col("source").cast("string").eqNullSafe(F.col("mix_key"))
        shard = F.expr(f"cast(pmod(xxhash64(doc_id, mix_size, {seed}L), mix_shards) as int)")
        return df.join(F.broadcast(counts), key).withColumn("mix_shard", shard).drop("mix_shards")

    shards = sharded(lean).groupBy("mix_key", "mix_shard").agg(F.sum("mix_size").alias("n")).collect()
    rule, block = plan(
        spark, [(r["mix_key"], r["mix_shard"], r["n"]) for r in shards], weights, max_repeats, seed, max_block
    )
    rule = rule.select(
        F.col("m_source").alias("mix_r_key"),
        F.col("m_shard").alias("mix_r_shard"),
        *(F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "passes", "rest", "blocks", "a", "c")),
    )
    order = Window.partitionBy("mix_key", "mix_shard").orderBy(
        F.expr(f"xxhash64({seed + 1}L, doc_id, mix_size)"), "doc_id", "mix_size"
    )
    before = F.coalesce(F.sum("mix_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = f"""transform(
        filter(
            if(mix_size > 0 and mix_rest > 0, sequence(mix_at div {block}L, (mix_at + mix_size - 1) div {block}L), array()),
            b -> pmod(mix_a * b + mix_c, mix_blocks) < mix_rest),
        b -> struct(greatest(b * {block}L - mix_at, 0L) as start, least((b + 1) * {block}L - mix_at, mix_size) as stop))"""
    placed = sharded(docs).withColumn("mix_at", before)
    return (
        placed.join(
            F.broadcast(rule) if len(shards) < 50_000 else rule,
            F.col("mix_key").eqNullSafe(F.col("mix_r_key")) & (F.col("mix_shard") == F.col("mix_r_shard")),
        )
        .withColumn("mix_ranges", F.expr(ranges))
        .withColumn(
            "mix_taken",
            F.expr("mix_passes * mix_size + aggregate(mix_ranges, 0L, (s, r) -> s + r.stop - r.start)"),
        )
        .drop("mix_r_key", "mix_r_shard", "mix_rest", "mix_blocks", "mix_a", "mix_c", "mix_at", "mix_shard", "mix_key")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each whole copy taken of a document, and
    one with the words of its chosen ranges (n_chars follows the text). What isn't taken is left out."""
    wide = sized(docs)
    q = quotas(wide, stats=materialise(wide.select("doc_id", "source", "mix_size"), "sizes"), **options)
    names = docs.columns
    word = re.compile(WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, texts = [], []
            rows = (batch.column(n).to_pylist() for n in ("text", "mix_passes", "mix_ranges"))
            for i, (text, passes, ranges) in enumerate(zip(*rows)):
                at += [i] * passes
                texts += [text] * passes
                if ranges:
                    spans = [m.span() for m in word.finditer(text)]
                    joined: list[list[int]] = []
                    for r in ranges:
                        if joined and joined[-1][1] == r["start"]:
                            joined[-1][1] = r["stop"]
                        else:
                            joined.append([r["start"], r["stop"]])
                    at.append(i)
                    texts.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joined))
            out = batch.select(names).take(pa.array(at, pa.int32()))
            cols = {n: out.column(n) for n in names}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    kept = q.filter("mix_taken > 0").withColumn("text", F.col("text").cast("string"))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.col("n_chars").cast("long"))
    schema = kept.select(names).schema
    return kept.select(*names, "mix_passes", "mix_ranges").mapInArrow(run, schema)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lean = materialise(sized(docs).drop("text"), "sizes")
    return quotas(lean).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )
