"""Tokenizer adapter and packing: equality with the library, exact round trips, little padding."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from helpers import documents, random_text, rng, words
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm import words as words_module
from glossa.llm.packing import SLICE, assign, pack
from glossa.llm.tokens import WordBpe
from glossa.llm.words import byte_hashes, char_hashes, text_slices

BPE = WordBpe()


def ids(text):
    return np.array(BPE.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoded(texts, bpe=BPE):
    flat, n = bpe.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    return [flat[e - k : e].tobytes() for e, k in zip(ends, n)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_ids_equal_the_library(texts):
    assert encoded(texts) == [ids(t) for t in texts]


def test_a_full_table_forgets_and_still_agrees():
    rnd, small = rng(3), WordBpe(cache=50)
    for _ in range(20):
        texts = [random_text(rnd, 80) for _ in range(10)] + [None, "’tis “odd” – and plain"]
        assert encoded(texts, small) == [ids(t or "") for t in texts]
    assert len(small.words) < 600


def test_slices_keep_long_texts_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 500, "", "z"]})
    parts = list(text_slices(iter([batch]), 20))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def test_a_slice_takes_little_memory():
    rnd, bpe = rng(6), WordBpe()
    batch = pa.record_batch({"text": [" ".join(words(rnd, 200, 20_000)) for _ in range(4000)]})
    tracemalloc.start()
    n = [bpe.encode(part.column("text"))[1] for part in text_slices([batch], SLICE)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, n)) == 4000 and peak < 70e6


def test_character_tables_take_little_memory(monkeypatch):
    kept = [t.copy() for t in words_module._tables()]
    monkeypatch.setattr(words_module, "_WORD", None)
    monkeypatch.setattr(words_module, "_SMALL", None)
    tracemalloc.start()
    again = words_module._tables()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(kept, again)) and peak < 20e6
    assert [bool(again[0][ord(c)]) for c in "a_é中 -"] == [True] * 4 + [False] * 2 and again[1][ord("É")] == ord("é")


def test_ids_equal_the_library_on_mixed_texts():
    rnd = rng(1)
    texts = [random_text(rnd, 60) for _ in range(300)] + ["", "don't we'll <|endoftext|> x", "É" * 50]
    assert encoded(texts) == [ids(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_assignment_places_every_token_once(lengths):
    pieces = assign(np.array(lengths, dtype=np.int64), 64)
    seen, room = {}, {}
    for d, start, k, seq, off in pieces:
        seen.setdefault(d, []).append((start, k))
        room.setdefault(seq, []).append((off, k))
    assert {d: sum(k for _, k in p) for d, p in seen.items()} == dict(enumerate(lengths))
    for p in seen.values():
        assert [a for a, _ in sorted(p)] == np.cumsum([0, *(k for _, k in sorted(p))])[:-1].tolist()
    for p in room.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0, *(k for _, k in p)])[:-1].tolist() and sum(k for _, k in p) <= 64
    assert len(room) == sum(n // 64 for n in lengths) + -(-sum(n % 64 for n in lengths) // 64)


def test_costs_are_balanced():
    rnd = random.Random(5)
    pieces = assign(np.array([rnd.randrange(20, 900) for _ in range(2000)]), 2048)
    cost = {}
    for _, _, k, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + k + k * k / 2048
    values = sorted(cost.values())
    assert values[-1] < 1.6 * values[len(values) // 20]


def test_pieces_rebuild_the_ids(spark):
    rnd = rng(2)
    rows = [(i, " ".join(words(rnd, rnd.choice([1, 5, 300, 3000])))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "no id here"), (7, rows[7][1])]
    got = pack(documents(spark, rows).withColumnRenamed("lang", "start"), 256).collect()
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(ids(text or "") + np.array([1], dtype="<u4").tobytes())
    for key, texts in want.items():
        own = [r for r in got if r["doc_id"] == key]
        assert sum(r["length"] for r in own) == sum(len(t) // 4 for t in texts)
        for r in own:
            assert any(zlib.crc32(t[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for t in texts)
    used = {r["sequence_id"] for r in got}
    assert sum(r["length"] for r in got) / (256 * len(used)) > 0.97


def test_empty_table(spark):
    assert pack(documents(spark, [])).count() == 0


def test_word_hashes_tell_words_apart():
    rnd = rng(4)
    texts = [random_text(rnd, 50) for _ in range(300)] + [None, "", "x" * 200, "x" * 199 + "y", "Ab aB AB", "é" * 70 + " É" * 3]
    for run, split in (
        (byte_hashes, lambda t: t.encode().lower().split()),
        (char_hashes, lambda t: re.findall(r"\w+", "".join(c.lower()[0] for c in t))),
    ):
        h, per = run(pa.array(texts, pa.string()))
        words = [w for t in texts for w in split(t or "")]
        assert per.tolist() == [len(split(t or "")) for t in texts] and len(h) == len(words)
        assert len(set(zip(h.tolist(), words))) == len(set(words)) == len(set(h.tolist()))
