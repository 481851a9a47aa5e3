"""Words of many texts at once, as arrays: cut from Arrow buffers and hashed without Python objects."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64, release

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Hashes add up one random number per place and symbol; numbers of the first places and symbols are kept.
_PLACES, _BYTES, _CHARS = 64, 8, 9


def _number(place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix64((place.astype(np.uint64) << np.uint64(21)) + symbol.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _table(bits: int) -> np.ndarray:
    at = np.arange(_PLACES << bits)
    return _number(at >> bits, at & ((1 << bits) - 1))


_BYTE_TABLE, _CHAR_TABLE = _table(_BYTES), _table(_CHARS)


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``max_bytes``: a longer text has one of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, a = np.cumsum(sizes, dtype=np.int64), 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(a, b - a)
            release()
            a = b


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each one starts and the last one ends; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true within texts that start at ``at[:-1]``, and runs per text."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1][(at[:-1] < n) & (at[1:] > at[:-1])]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    stop = at[1:][(at[1:] > at[:-1])] - 1
    last[stop] = inside[stop]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per = np.diff(np.searchsorted(starts, at))
    return starts, ends - starts, per


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words' hashes (63 bits) from the numbers of their symbols."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    return (mix64(np.add.reduceat(values, np.cumsum(lengths) - lengths)) >> np.uint64(1)).astype(np.int64)


def _hash(symbols: np.ndarray, lengths: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    place = np.arange(len(symbols), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    at = (np.minimum(place, _PLACES - 1) << bits) | (symbols & ((1 << bits) - 1)).astype(np.int32)
    values = table[at]
    if (len(lengths) and int(lengths.max()) > _PLACES) or (bits == _CHARS and len(symbols) and int(symbols.max()) >> bits):
        rare = np.flatnonzero((place >= _PLACES) | (symbols >> bits > 0))
        values[rare] = _number(place[rare], symbols[rare])
    return _sums(values, lengths)


def split_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, each word's length, and words per text: runs without space, tab, line and page breaks."""
    data, at = _buffer(texts)
    inside = ~_WHITE[data]
    starts, lengths, per = _runs(inside, at)
    return data[inside], lengths, per


def byte_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all words as ``split_bytes`` has them, A-Z lower-cased; and words per text."""
    data, lengths, per = split_bytes(texts)
    return _hash(_LOWER[data], lengths, _BYTES, _BYTE_TABLE), per


_WORD: np.ndarray | None = None
_SMALL: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a word character, and its lower case (its first letter, if several)."""
    global _WORD, _SMALL
    if _WORD is None:
        # In blocks: a million strings at once would fill each worker.
        kinds, low = np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.uint32)
        for a in range(0, 0x110000, 1 << 12):
            chars = [chr(c) for c in range(a, a + (1 << 12))]
            kinds[a : a + len(chars)] = [c.isalnum() or c == "_" for c in chars]
            for i, c in enumerate(chars, a):
                if unicodedata.category(c) in ("Lu", "Lt", "Nl", "So") and (s := c.lower()) != c:
                    low[i] = ord(s[0])
        _WORD = kinds
        _SMALL = low
    return _WORD, _SMALL


def char_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all runs of word characters, lower-cased letter by letter; and words per text."""
    word, small = _tables()
    data, at = _buffer(texts)
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    # Code points before each byte offset: those bytes that don't continue one.
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inside = word[cps]
    _, lengths, per = _runs(inside, heads[at])
    return _hash(small[cps[inside]], lengths, _CHARS, _CHAR_TABLE), per
