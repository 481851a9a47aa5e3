"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

Each document costs ``linear * tokens + quadratic * tokens ** 2`` (attention is within documents). In
windows of consecutive documents, descending documents go to the lowest-cost sequence that still has
room for them; what fits nowhere whole is cut into the rooms that are left. Windows are packed where
their rows lie, so nothing is shuffled and memory is bounded; a window's sequences are as few as hold
its tokens, and together have less than one sequence of padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, read_table, to_batch, worker_state
from .tokens import WordBpe
from .words import text_slices

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("cost", pa.float64())]
)
#: A window ends at so many documents or tokens; both bound a task's memory.
WINDOW_DOCS, WINDOW_TOKENS = 4096, 4_000_000
#: Bytes of text that are tokenised at once; a longer text is taken alone. For the words of 2 MB a worker holds
#: about 150 MB, beside an executor whose heap earlier stages may have filled.
SLICE = 2 << 20


def assign(
    lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048
) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a window of documents with these token counts.

    Whole multiples of the capacity fill sequences of their own. The remainders go, longest first (ties:
    the earlier document), to the lowest-cost sequence (ties: the first) with room; the rest is cut.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    full, rest = lengths // capacity, lengths % capacity
    out, seq = [], 0
    for d in np.flatnonzero(full):
        for k in range(full[d]):
            out.append((int(d), k * capacity, capacity, seq, 0))
            seq += 1
    n = -(-int(rest.sum()) // capacity)
    room, cost = np.full(n, capacity, dtype=np.int64), np.zeros(n)

    def place(d: int, start: int, length: int, j: int) -> None:
        out.append((d, start, length, seq + j, capacity - int(room[j])))
        room[j] -= length
        cost[j] += linear * length + quadratic * length * length

    late = []
    for d in np.argsort(-rest, kind="stable"):
        r = int(rest[d])
        if r == 0:
            break
        j = int(np.argmin(np.where(room >= r, cost, np.inf)))
        if room[j] >= r:
            place(int(d), int(full[d]) * capacity, r, j)
        else:
            late.append(int(d))
    for d in late:
        start, r = int(full[d]) * capacity, int(rest[d])
        while r:
            fits = np.flatnonzero(room >= r)
            j = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            part = min(r, int(room[j]))
            place(d, start, part, j)
            start, r = start + part, r - part
    return out


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text; further columns are ignored): see ``SCHEMA``.

    A null or empty text has the end id alone; a null doc_id stays null; repeated rows are packed as
    often as they occur; an empty table gives no pieces. ``cost`` is the piece's estimated cost.
    sequence_id holds the partition in its high bits, so it is unique over the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(("WordBpe", tokenizer_dir), lambda: WordBpe(tokenizer_dir))
        base = TaskContext.get().partitionId() << 36
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        docs_held = tokens_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, docs_held, tokens_held
            keys = pa.concat_arrays([k for k, *_ in held])
            n = np.concatenate([c for *_, c in held])
            ids = memoryview(np.concatenate([i for _, i, _ in held])).cast("B")
            at = np.cumsum(n) - n
            d, start, length, seq, offset = np.array(assign(n, capacity, linear, quadratic), dtype=np.int64).reshape(-1, 5).T
            first = at[d] + start
            crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + length).tolist())]
            batch = to_batch(
                _ARROW,
                [keys.take(pa.array(d)), start, length, crc, n[d], base + seq, offset, linear * length + quadratic * length * length],
            )
            base += 1 + int(seq.max(initial=0))
            held.clear()
            docs_held = tokens_held = 0
            return batch

        for part in text_slices(batches, SLICE):
            ids, n = bpe.encode(part.column("text"))
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            # A window ends with the document that fills it.
            ends, a, b = np.cumsum(n), 0, 0
            while b < len(n):
                done = int(ends[a - 1]) if a else 0
                b = 1 + int(np.searchsorted(ends, done + WINDOW_TOKENS - tokens_held))
                b = min(len(n), max(b, a + 1), a + WINDOW_DOCS - docs_held)
                held.append((part.column("doc_id").slice(a, b - a), ids[done : ends[b - 1]], n[a:b]))
                docs_held += b - a
                tokens_held += int(ends[b - 1]) - done
                if docs_held >= WINDOW_DOCS or tokens_held >= WINDOW_TOKENS:
                    yield flush()
                a = b
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
