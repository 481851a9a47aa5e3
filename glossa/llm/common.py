"""Helpers that several corpus operators share: scratch tables, word hashing, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Where the vocabulary files of public tokenizers lie; operators take another folder as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"

WORD = re.compile(r"\w+")
#: Words kept in a worker's hash cache; words beyond it are hashed again in each batch.
CACHE_WORDS = 150_000
#: Bytes of an Arrow batch on its way to a worker, about.
BATCH_BYTES = 4 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset (tests, one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or _own_dir(spark)
    return f"{base.rstrip('/')}/glossa-{uuid.uuid4().hex}-{name}"


def _own_dir(spark: SparkSession) -> str:
    base = "file://" + tempfile.mkdtemp(prefix="glossa-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back: cuts lineage and survives lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone already when the interpreter ends
        pass


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to workers hold about BATCH_BYTES, unless the session says otherwise: rows of long
    texts would fill memory twice, in the executor and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """word -> 63-bit hash, computed once per word and worker."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word) >> 1
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
_STATE: dict[tuple, object] = {}


def worker_state(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` returns, made once per worker process and kept for its later tasks.

    A worker keeps the state of one operator only, so what earlier ones held is free again.
    """
    if key not in _STATE:
        _STATE.clear()
        gc.collect()
        release()
        _STATE[key] = make()
    return _STATE[key]


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield batch.slice(k, size)
    release()


def rows(batches: Iterator[pa.RecordBatch], max_chars: int, column: str = "text") -> Iterator[dict[str, list]]:
    """Arrow batches as dicts of lists, cut where the texts of one hold ``max_chars`` characters."""
    held: dict[str, list] = {}
    chars = n_rows = 0
    for batch in slices(batches, 100):
        for name, v in zip(batch.schema.names, batch.columns):
            held.setdefault(name, []).extend(v.to_pylist())
        chars += sum(len(t) for t in held[column][n_rows:] if t is not None)
        n_rows += batch.num_rows
        if chars >= max_chars or n_rows >= 20_000:
            yield held
            held, chars, n_rows = {}, 0, 0
    if held:
        yield held


def to_batch(schema: pa.Schema, cols: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def one_thread() -> None:
    """Tokenizer libraries must not start threads of their own beside Spark's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
