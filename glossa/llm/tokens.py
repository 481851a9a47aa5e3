"""Tokenizer adapters for workers: whole texts to ids, with a bounded table of words already encoded.

The vocabulary files are read from a folder that is a parameter; nothing is copied or trained.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import TOKENIZER_DIR, one_thread
from .words import split_bytes

#: Words whose ids a worker keeps, at most: about 40 bytes each. Where it is full the rarer half goes.
CACHE = 200_000
#: Words that the library cuts and encodes at once.
TOGETHER = 200_000
_TOP = 0x180
#: Words with other characters (or U+0130, which lower-cases to two) go to the library whole.
_UNSAFE = re.compile("[^\x00-\x1b!-įı-ſ]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_TOP) if unicodedata.category(chr(c))[0] == kind)


_SPACE = "\t-\r \x85\xa0"
#: Pre-tokens of many words at once; a line break ends a word.
_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|\n|[^{_SPACE}{_class('L')}{_class('N')}]+"
)


def _byte_map() -> dict[int, str]:
    """latin-1 characters to the printable stand-ins that byte-level vocabularies use; the space stays."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest) if b != 32}


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class WordBpe:
    """ids of ``word_bpe_49k.json`` for many texts, equal to ``Tokenizer.encode(..., add_special_tokens=False)``.

    Texts are split at white space and each distinct word is encoded once. Words of common Latin
    characters are cut into pre-tokens here; every pre-token ends with a word-end token, so distinct ones
    are encoded as one text and split again. Strings of special tokens count as ordinary text.
    """

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = "word_bpe_49k.json", cache: int = CACHE):
        one_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(f"{folder}/{name}")
        self.tok.encode_special_tokens = True
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for t, i in self.tok.get_vocab().items():
            self.ends[i] = t.endswith("</w>")
        self.map = _byte_map()
        self.room = cache
        self.words = pa.array([], pa.large_binary())
        self.ids, self.starts = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.lengths, self.uses = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct pre-tokens, and the start and length of each one's."""
        flat = " ".join(pieces).encode().decode("latin-1").translate(self.map)
        ids = np.array(self.bare.encode_batch_fast([flat], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(cuts) != len(pieces) + 1:
            raise AssertionError("pre-tokens and their ids disagree")
        return ids, cuts[:-1], np.diff(cuts)

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words one after the other, and how many each has."""
        ids, lengths = [], []
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            odd = [i for i, w in enumerate(part) if _UNSAFE.search(w)] if _UNSAFE.search("".join(part)) else []
            whole = self.tok.encode_batch_fast([part[i] for i in odd], add_special_tokens=False)
            for i in odd:
                part[i] = ""
            pieces = _PIECE.findall("\n".join(part).lower() + "\n")
            order = list(dict.fromkeys(pieces))
            order.remove("\n")
            row = dict(zip(order, range(len(order)))) | {"\n": -1}
            at = np.fromiter(map(row.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            stops = np.flatnonzero(at < 0)
            at = at[at >= 0]
            per = np.diff(np.concatenate([[-1], stops])) - 1
            if order:
                flat, starts, n = self._pieces(order)
                out, n = _gather(flat, starts[at], n[at]), n[at]
            else:
                out, n = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(n)])
            to = np.cumsum(per)
            own = sums[to] - sums[to - per]
            if odd:
                cuts = np.concatenate([[0], np.cumsum(own)])
                runs = [out[a:b] for a, b in zip(cuts, cuts[1:])]
                for i, e in zip(odd, whole):
                    runs[i] = np.array(e.ids, dtype="<u4")
                out, own = np.concatenate(runs), np.array([len(r) for r in runs], dtype=np.int64)
            ids.append(out.astype("<u4"))
            lengths.append(own)
        return np.concatenate(ids), np.concatenate(lengths)

    def _forget(self) -> None:
        """Keep the more used half of a full table; later uses count anew."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.room // 2])
        self.ids = _gather(self.ids, self.starts[keep], self.lengths[keep])
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = np.zeros(len(keep), dtype=np.int64)
        self.words = self.words.take(pa.array(keep))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (little-endian unsigned 32-bit) of all texts one after the other, and how many each has."""
        data, sizes, per = split_bytes(texts)
        off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(data)])
        if len(self.words) > self.room:
            self._forget()
        rows = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            some = words.take(pa.array(missing)).dictionary_encode()
            new, rows[missing] = some.dictionary, some.indices.to_numpy().astype(np.int64) + len(self.words)
            ids, lengths = self._encode_new(new.cast(pa.large_string()).to_pylist())
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])
            self.words = pa.concat_arrays([self.words, new])
        self.uses += np.bincount(rows, minlength=len(self.uses))
        n = self.lengths[rows]
        sums = np.concatenate([[0], np.cumsum(n)])
        to = np.cumsum(per)
        return _gather(self.ids, self.starts[rows], n), sums[to] - sums[to - per]
