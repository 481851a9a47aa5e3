"""Sections, sentences, tokens with character offsets, and token n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

WORD = r"[\p{L}\p{N}]+"
#: Bytes of text that a scan holds as arrays at a time, and rows that it returns at once, about.
SLICE_BYTES = 1 << 20
OUT_ROWS = 1 << 16
_WORD_TABLE: np.ndarray | None = None
#: Documents of this length or more aren't processed.
MAX_CHARS = 200_000


def simple_sections(docs: DataFrame, text: str = "text", name: str = "na") -> DataFrame:
    """Each document as one section: doc_id, section_idx, name, text."""
    return docs.select("doc_id", F.lit(0).alias("section_idx"), F.lit(name).alias("name"), F.col(text).alias("text"))


def admit(docs: DataFrame, max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """(documents to process, documents that are too long, with the reason)."""
    size = F.coalesce(F.length("text"), F.lit(0))
    late = docs.filter(size >= max_chars).withColumn("error", F.concat(F.lit("document too long: "), size.cast("string")))
    return docs.filter(size < max_chars), late


def _word_characters() -> np.ndarray:
    """Of each code point, whether ``WORD`` has it; made once per worker."""
    global _WORD_TABLE
    if _WORD_TABLE is None:
        table = np.zeros(0x110000, dtype=bool)
        for a in range(0, 0x110000, 1 << 12):
            for m in regex.finditer(WORD, "".join(map(chr, range(a, a + (1 << 12))))):
                table[a + m.start() : a + m.end()] = True
        _WORD_TABLE = table
    return _WORD_TABLE


class _Tokens:
    """Tokens of the texts of a slice as arrays: text by text, ``row`` the text of each, spans in characters
    (``start``, ``end``, within the text) and in bytes of ``data`` (``left``, ``right``)."""

    def __init__(self, texts: pa.Array, pattern: str):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        at = at - at[0]
        #: The byte at which each character begins, and the end; the characters before each text.
        place = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        heads = np.searchsorted(place, at)
        whole = self.data.tobytes().decode()
        if pattern == WORD:
            inside = _word_characters()[np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")]
            # A run ends where the next text begins.
            flag = np.zeros(len(inside) + 1, dtype=bool)
            flag[1:] = inside
            first, last = inside & ~flag[:-1], np.zeros(len(inside), dtype=bool)
            cut = heads[(heads > 0) & (heads < len(inside))]
            first[cut] = inside[cut]
            last[:-1] = inside[:-1] & ~inside[1:]
            last[-1:] = inside[-1:]
            last[cut - 1] = inside[cut - 1]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            find = regex.compile(pattern).finditer
            spans = [(a + m.start(), a + m.end()) for a, b in zip(heads[:-1], heads[1:]) for m in find(whole[a:b])]
            start, end = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        #: Tokens before each text, and the text of each token.
        self.at = np.searchsorted(start, heads)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.left, self.right, self.edge = place[start], place[end], at
        self.start, self.end = (start - heads[self.row]).astype(np.int32), (end - heads[self.row]).astype(np.int32)

    def strings(self, left: np.ndarray, right: np.ndarray) -> pa.Array:
        """The text between such bytes, for each pair."""
        size = np.maximum(right - left, 0)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(left - (ends - size), size)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(self.data[at]))


def _slices(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[pa.RecordBatch, _Tokens]]:
    """The same rows, so few at a time that their texts hold about SLICE_BYTES (a longer text comes alone), with their tokens."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, side="right")))
            part = batch.slice(a, b - a)
            yield part, _Tokens(part.column("text"), pattern)
            a = b


def _parts(sections: DataFrame) -> DataFrame:
    bound_batches(sections.sparkSession)
    return sections.select(F.col("doc_id").cast("long"), F.col("section_idx").cast("int"), "text")


def _keys(part: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    return [part.column(c).take(pa.array(row)) for c in ("doc_id", "section_idx")]


def section_tokens(sections: DataFrame, pattern: str = WORD) -> DataFrame:
    """(doc_id, section_idx, tokens): the section's tokens in order, each with its span and the gap after it.

    Offsets need a scan with carried state, which row expressions only have at quadratic cost and
    windows only with a shuffle of all tokens; an Arrow-batched scan has neither. It holds a slice of the
    texts at a time, as arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _slices(batches, pattern):
            # The gap goes on to the next token of the text, or to its end.
            after = np.append(t.left[1:], len(t.data))[: len(t.left)]
            after[t.at[1:][np.diff(t.at) > 0] - 1] = t.edge[1:][np.diff(t.at) > 0]
            each = pa.StructArray.from_arrays(
                [pa.array(t.start), pa.array(t.end), t.strings(t.left, t.right), t.strings(t.right, after)], ["start", "end", "token", "gap"]
            )
            tokens = pa.ListArray.from_arrays(pa.array(t.at.astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("section_idx"), tokens], names=["doc_id", "section_idx", "tokens"])

    return _parts(sections).mapInArrow(
        run, "doc_id long, section_idx int, tokens array<struct<start:int,end:int,token:string,gap:string>>"
    )


def explode_tokens(tokens: DataFrame) -> DataFrame:
    """doc_id, section_idx, pos, start, end, token: one row per token."""
    return tokens.select("doc_id", "section_idx", F.posexplode("tokens").alias("pos", "t")).select(
        "doc_id", "section_idx", "pos", "t.start", "t.end", "t.token"
    )


def token_rows(sections: DataFrame, pattern: str = WORD) -> DataFrame:
    """doc_id, section_idx, pos, start, end, token, gap: one row per token, straight from the scan.

    ``gap`` is the text between the token before and this one, empty for the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _slices(batches, pattern):
            pos = np.arange(len(t.row)) - t.at[t.row]
            before = np.where(pos > 0, np.append(0, t.right[:-1])[: len(pos)], t.left)
            for a in range(0, len(t.row), OUT_ROWS):
                k = slice(a, a + OUT_ROWS)
                cols = [pa.array(pos[k].astype(np.int32)), pa.array(t.start[k]), pa.array(t.end[k]), t.strings(t.left[k], t.right[k]), t.strings(before[k], t.left[k])]
                yield pa.RecordBatch.from_arrays(_keys(part, t.row[k]) + cols, names=["doc_id", "section_idx", "pos", "start", "end", "token", "gap"])

    return _parts(sections).mapInArrow(run, "doc_id long, section_idx int, pos int, start int, end int, token string, gap string")


def token_ngrams(sections: DataFrame, max_tokens: int) -> DataFrame:
    """doc_id, section_idx, start, end, n, ngram: the text of every run of up to so many tokens.

    These are all spans whose both ends are token boundaries. The scan that finds the tokens cuts them from
    its own text, so the text is never joined again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _slices(batches, WORD):
            for n in range(1, max_tokens + 1):
                head = np.flatnonzero(t.row[n - 1 :] == t.row[: len(t.row) - n + 1]) if n <= len(t.row) else np.zeros(0, dtype=np.int64)
                for a in range(0, len(head), OUT_ROWS):
                    i = head[a : a + OUT_ROWS]
                    j = i + n - 1
                    cols = [pa.array(t.start[i]), pa.array(t.end[j]), pa.array(np.full(len(i), n, dtype=np.int32)), t.strings(t.left[i], t.right[j])]
                    yield pa.RecordBatch.from_arrays(_keys(part, t.row[i]) + cols, names=["doc_id", "section_idx", "start", "end", "n", "ngram"])

    return _parts(sections).mapInArrow(run, "doc_id long, section_idx int, start int, end int, n int, ngram string")


def sentences(sections: DataFrame) -> DataFrame:
    """doc_id, section_idx, sentence_idx, start, end: sentences end after ``.``, ``!`` or ``?`` before white space."""
    pieces = F.split(F.regexp_replace("text", r"([.!?]+)(\s+)", "$1$2\u0001"), "\u0001")
    ends = F.aggregate(
        pieces, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p)))
    )
    spans = F.zip_with(pieces, ends, lambda p, e: F.struct((e - F.length(p)).alias("start"), (e - F.length(p) + F.length(F.rtrim(p))).alias("end")))
    return (
        sections.filter(F.length("text") > 0)
        .select("doc_id", "section_idx", F.posexplode(spans).alias("sentence_idx", "s"))
        .filter("s.end > s.start")
        .select("doc_id", "section_idx", "sentence_idx", "s.start", "s.end")
    )


def windows(items: DataFrame, column: str, size: int = 512, stride: int = 128) -> DataFrame:
    """Frames of an array column: window_idx, first, frame; neighbours share ``stride`` items."""
    n = F.size(column)
    step = size - stride
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1 - F.lit(stride), F.lit(step)))
    return (
        items.withColumn("first", F.explode(starts))
        .withColumn("frame", F.slice(F.col(column), F.col("first") + 1, F.lit(size)))
        .withColumn("window_idx", (F.col("first") / step).cast("int"))
    )


def stitch(frames: DataFrame, keys: list[str], stride: int = 128) -> DataFrame:
    """Undo ``windows`` on frames of predictions: half of each overlap comes from either side."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    half = stride // 2
    n = F.size("frame")
    is_first = F.col("window_idx") == F.min("window_idx").over(w)
    is_last = F.col("window_idx") == F.max("window_idx").over(w)
    skip = F.when(is_first, 0).otherwise(half)
    drop = F.when(is_last, 0).otherwise(stride - half)
    kept = frames.withColumn("part", F.slice("frame", skip + 1, F.greatest(n - skip - drop, F.lit(0))))
    return kept.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window_idx", "part"))), lambda s: s["part"])).alias("items"))
