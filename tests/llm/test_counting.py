"""Edit-aware counts equal those of encoding the edited text anew."""

import base64

import public_tokenizers as P
import tiktoken
from helpers import documents, random_text, rng

from glossa.llm.counting import PieceCounts, TokenTree, apply_edits, count_edited, standard_edits

COUNTS = PieceCounts()
with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
    FULL = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def n_tokens(text):
    return len(FULL.encode_ordinary(text))


def test_edits_equal_a_full_count():
    rnd = rng(0)
    for _ in range(600):
        text = random_text(rnd, rnd.randrange(60))
        tree, done = TokenTree(text, COUNTS, leaf=rnd.choice([1, 2, 5])), []
        for _ in range(4):
            start = rnd.randrange(150)
            done.append((start, start + rnd.randrange(12), random_text(rnd, rnd.randrange(4))))
            tree.edit(*done[-1])
            assert tree.text == apply_edits(text, done) and tree.total == n_tokens(tree.text)
            assert tree.prefix(0) == 0 and tree.chars[1] == len(tree.text)


def test_long_texts_are_only_encoded_around_the_edits():
    text = "some words of a long text. " * 4000
    tree = TokenTree(text, COUNTS)
    tree.edit(50_000, 50_010, "else")
    assert tree.total == n_tokens(tree.text) and tree.encoded < 2_000


def test_table(spark):
    rnd = rng(2)
    rows = [(i, random_text(rnd, 200)) for i in range(20)] + [(30, None), (31, ""), (None, "x y"), (3, "again")]
    got = count_edited(documents(spark, rows).withColumnRenamed("lang", "n_tokens")).collect()
    want = [(k, n_tokens(t or ""), len(e := apply_edits(t or "", standard_edits(t or "", k))), n_tokens(e)) for k, t in rows]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["edited_chars"], r["edited_tokens"]) for r in got), key=key) == sorted(want, key=key)
    assert count_edited(documents(spark, [])).count() == 0
