"""Small fixtures for the corpus operators."""

import random


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, rows):
    """doc_id, text, lang, source, n_chars of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def near_copy(rnd, text, rate=0.1):
    return " ".join(f"x{rnd.randrange(99)}" if rnd.random() < rate else w for w in text.split())


def random_text(rnd, n):
    alphabet = ["a", "b", "é", "ß", "İ", "中", " ", "  ", "\n", "'s", "1", "!", "the ", "Of ", "\x1c", " ", "😀"]
    return "".join(rnd.choice(alphabet) for _ in range(n))


def rng(seed=0):
    return random.Random(seed)
