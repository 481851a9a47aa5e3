"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch.

A document's pre-tokens (the pieces that a byte-level BPE encodes on their own) are cut into leaves of
some dozens; a binary tree over the leaves holds characters and tokens of each subtree. An edit goes down
the tree to the leaves that it touches; their text is cut again from a leaf before the edit (so its left
context is the old one) until a piece ends where an old leaf ended; only those leaves are replaced and
only the sums above them are updated. The new counts equal those of encoding the edited text anew.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_WORDS, TOKENIZER_DIR, read_table, rows, to_batch

#: White space as the tokenizer's pattern means it.
_S = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
#: No piece depends on text further than this beyond its end.
LOOK = 3
LEAF = 16


class PieceCounts(dict):
    """piece -> number of tokens, by the ranks of a public vocabulary; kept per worker."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken"):
        super().__init__()
        import tiktoken

        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < CACHE_WORDS:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, PIECES.findall(text)))


class TokenTree:
    """A text with the token counts of its leaves and subtrees; ``edit`` keeps them up to date."""

    def __init__(self, text: str, counts: PieceCounts, leaf: int = LEAF):
        self.text, self.counts, self.leaf = text, counts, leaf
        pieces = PIECES.findall(text)
        leaves = [
            (sum(map(len, part)), sum(map(counts.__getitem__, part)))
            for part in (pieces[k : k + leaf] for k in range(0, len(pieces), leaf))
        ]
        #: Characters that were cut and encoded since the tree was built.
        self.encoded = 0
        self._build(leaves)

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.size = 1
        while self.size < max(1, len(leaves)):
            self.size *= 2
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        for i, (c, t) in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = c, t
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds the character at this place, or the last one."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def prefix(self, leaf: int) -> int:
        """Tokens before a leaf, from the subtree sums."""
        i, out = leaf + self.size, 0
        while i > 1:
            if i % 2:
                out += self.tokens[i - 1]
            i //= 2
        return out

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace text[start:stop] by ``new``; returns the new total."""
        n = len(self.text)
        start = max(0, min(start, n))
        stop = max(start, min(stop, n))
        first, begin = self._find(max(0, start - LOOK))
        # One leaf more to the left: pieces that end right before the edit may reach into it.
        while first and begin > max(0, start - LOOK - 1):
            first -= 1
            begin -= self.chars[self.size + first]
        # The leaf that holds the end of the edit, and where leaves end after it in the new text.
        last, at = self._find(max(start, stop - 1) if stop > start else start)
        end = at + self.chars[self.size + last]
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        fixed = start + len(new)
        pos, toks = begin, 0
        goal = end + shift
        for m in PIECES.finditer(self.text, begin):
            if pos >= fixed and pos >= goal:
                while pos > goal and last + 1 < self.size:
                    last += 1
                    goal += self.chars[self.size + last]
                if pos == goal:
                    break
            toks += self.counts[m[0]]
            pos = m.end()
        else:
            last = self.size - 1
        self.encoded += pos - begin
        self._replace(first, last, pos - begin, toks)
        return self.total

    def _replace(self, first: int, last: int, chars: int, tokens: int) -> None:
        touched = set()
        for leaf in range(first, last + 1):
            i = leaf + self.size
            c, t = (chars, tokens) if leaf == first else (0, 0)
            if (self.chars[i], self.tokens[i]) != (c, t):
                self.chars[i], self.tokens[i] = c, t
                touched.add(i // 2)
        while touched:
            up = set()
            for i in touched:
                if i:
                    self._sum(i)
                    up.add(i // 2)
            touched = up - {0}


Edit = tuple[int, int, str]


def standard_edits(text: str, key: int | None) -> list[Edit]:
    """Three edits for any text: a replacement at a third, an insertion in the middle, a deletion near the end."""
    n = len(text)
    return [
        (n // 3, n // 3 + n // 50, f" edit {key} of this text"),
        (n // 2, n // 2, "\n\n" + text[: min(40, n)][::-1]),
        (n - n // 5, n - n // 5 + n // 40, ""),
    ]


def count_edited(docs: DataFrame, edits=standard_edits, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, n_tokens, n_edits, edited_chars, edited_tokens, encoded_chars for each row (doc_id, text).

    ``edits`` gives (start, stop, new) for a text and its id; each applies to the text as the ones before
    it left it, with places beyond the end moved to it. encoded_chars counts what was encoded again. Null
    texts count as empty. Repeated rows come out alike; an empty table gives no rows.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "encoded_chars")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(tokenizer_dir)
        for part in rows(batches, 4_000_000):
            out = []
            for key, text in zip(part["doc_id"], part["text"]):
                tree = TokenTree(text or "", counts)
                before, todo = tree.total, list(edits(text or "", key))
                for start, stop, new in todo:
                    tree.edit(start, stop, new)
                out.append((key, before, len(todo), len(tree.text), tree.total, tree.encoded))
            yield to_batch(schema, zip(*out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join(f"{f.name} long" for f in schema)
    )


def apply_edits(text: str, edits: Iterable[Edit]) -> str:
    """The text after the edits, without any tree: what ``TokenTree`` must agree with."""
    for start, stop, new in edits:
        start = max(0, min(start, len(text)))
        stop = max(start, min(stop, len(text)))
        text = text[:start] + new + text[stop:]
    return text


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(read_table(spark, sf_dir, "documents"))
