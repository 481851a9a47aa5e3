"""Synonym generation and automatic curation over string columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import GREEK, classify_symbolic
from .curation import DROP, POSSIBLE, PROBABLE

Generator = Callable[[Column], Column]

STOP_WORDS = ("and", "by", "caused", "in", "involved", "of", "the", "to", "with")
DASHES = ("−", "-", *(chr(c) for c in range(0x2010, 0x2016)))


def _new(found: Column, c: Column) -> Column:
    return F.filter(F.array_distinct(found), lambda s: (s != c) & (s != ""))


def drop_stop_words(c: Column, words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The string without stop words, if it has any."""
    kept = F.filter(F.split(c, " "), lambda w: ~F.lower(w).isin(*words))
    return F.when(F.size(kept) < F.size(F.split(c, " ")), F.array(F.array_join(kept, " "))).otherwise(F.array().cast("array<string>"))


def hyphenate(c: Column, dashes: tuple[str, ...] = DASHES) -> Column:
    """Two words joined by every kind of dash."""
    words = F.split(c, " ")
    return F.when(F.size(words) == 2, F.array(*(F.concat_ws(d, words[0], words[1]) for d in dashes))).otherwise(F.array().cast("array<string>"))


def replace_strings(table: dict[str, list[str]], before_digits: dict[str, list[str]] | None = None) -> Generator:
    """Each replacement by itself, trimmed; ``before_digits`` only right before digits."""

    def gen(c: Column) -> Column:
        out = [F.trim(F.replace(c, F.lit(old), F.lit(new))) for old, news in table.items() for new in news]
        for old, news in (before_digits or {}).items():
            esc = "".join("\\" + ch if not ch.isalnum() else ch for ch in old)
            out += [F.regexp_replace(c, esc + r"(?=\d)", new) for new in news]
        return _new(F.array(*out), c)

    return gen


def greek_variants(c: Column) -> Column:
    """Letters by their names and names by letters, one kind of letter at a time."""
    out = []
    for letter, name in GREEK.items():
        out.append(F.replace(c, F.lit(letter), F.lit(name)))
        out.append(F.regexp_replace(c, rf"(?<=^|[\s\-]){name}(?=$|[\s\-])", letter))
    return _new(F.array(*out), c)


def swap_suffixes(suffixes: tuple[str, ...]) -> Generator:
    """An ending of the set replaced by each of the others."""

    def gen(c: Column) -> Column:
        stem = lambda s: c.substr(F.lit(1), F.length(c) - len(s))
        out = [F.when(c.endswith(a), F.concat(stem(a), F.lit(b))) for a in suffixes for b in suffixes if a != b]
        return _new(F.filter(F.array(*out), lambda s: s.isNotNull()), c)

    return gen


def swap_tokens(lists: list[tuple[str, ...]]) -> Generator:
    """One word replaced by every other word of a list that it is in."""

    def gen(c: Column) -> Column:
        words = F.split(c, " ")

        def swapped(group: tuple[str, ...], new: str) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.lower(F.get(words, i)).isin(*group))
            return F.transform(at, lambda i: F.array_join(F.transform(words, lambda w, k: F.when(k == i, F.lit(new)).otherwise(w)), " "))

        out = [swapped(group, new) for group in lists for new in group]
        return _new(F.concat(*out), c)

    return gen


def spelling_variants(strings: DataFrame, table: DataFrame) -> DataFrame:
    """text, variant: variants of the lower-cased string by a table (word, variant)."""
    return strings.join(F.broadcast(table), F.lower("text") == F.col("word")).select("text", "variant").distinct()


def expand_brackets(c: Column) -> Column:
    """Forms without a bracketed part, and with it but without its brackets."""
    out = F.array(F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*", " ")), F.regexp_replace(c, r"[()]", ""))
    return F.when(c.contains("("), _new(out, c)).otherwise(F.array().cast("array<string>"))


def generate(resources: DataFrame, generators: list[Generator]) -> DataFrame:
    """resource_key, text: alternative strings by all orders of the generators.

    ``resources``: resource_key, text. Within an order a generator reads what the ones before it made, or
    the originals while nothing was made. Strings that are an original of any resource are left out.
    """
    originals = resources.select("resource_key", "text").distinct()
    out = None
    for order in permutations(generators):
        made = None
        for gen in order:
            if made is None:
                fresh = originals.select("resource_key", F.explode(gen(F.col("text"))).alias("text"))
            else:
                have = made.select("resource_key").distinct()
                source = made.unionByName(originals.join(have, "resource_key", "left_anti"))
                fresh = made.unionByName(source.select("resource_key", F.explode(gen(F.col("text"))).alias("text")))
            made = fresh.distinct()
        out = made if out is None else out.unionByName(made)
    return out.distinct().join(originals.select("text").distinct(), "text", "left_anti").select("resource_key", "text")


#: Automatic curation: actions on rows (originals array<string>, case_sensitive, confidence, behaviour).
Action = Callable[[DataFrame], DataFrame]


def symbolic_case(entity_class: str | None = None) -> Action:
    """Resources whose strings are all symbolic become case-sensitive."""
    test = lambda s: classify_symbolic(s, entity_class)
    return lambda df: df.withColumn("case_sensitive", F.col("case_sensitive") | F.forall("originals", test))


def common_words(words: tuple[str, ...]) -> Action:
    """A string made of common words only makes its resource POSSIBLE."""
    test = lambda s: F.forall(F.split(F.lower(s), " "), lambda w: w.isin(*words))
    return lambda df: df.withColumn("confidence", F.when(F.exists("originals", test), POSSIBLE).otherwise(F.col("confidence")))


def length_limits(least: int = 2, most: int = 60) -> Action:
    """Too short or too long a string drops its resource."""
    test = lambda s: (F.length(s) < least) | (F.length(s) > most)
    return lambda df: df.withColumn("behaviour", F.when(F.exists("originals", test), DROP).otherwise(F.col("behaviour")))


def capitals_ignore_case(df: DataFrame) -> DataFrame:
    """Resources of words in capitals only match in any case."""
    return df.withColumn("case_sensitive", F.col("case_sensitive") & ~F.forall("originals", lambda s: s.rlike(r"^\p{Lu}+$")))


def mixed_case(df: DataFrame) -> DataFrame:
    """A string that begins in lower case and goes on in upper case makes its resource case-sensitive."""
    return df.withColumn("case_sensitive", F.col("case_sensitive") | F.exists("originals", lambda s: s.rlike(r"^\p{Ll}\p{Lu}")))


def multiword(df: DataFrame) -> DataFrame:
    """A string of several words makes its resource PROBABLE."""
    return df.withColumn("confidence", F.when(F.exists("originals", lambda s: F.trim(s).contains(" ")), PROBABLE).otherwise(F.col("confidence")))


def acronyms(df: DataFrame) -> DataFrame:
    """Resources of short strings in capitals are POSSIBLE."""
    test = lambda s: (F.length(s) <= 5) & (s == F.upper(s)) & s.rlike(r"\p{Lu}")
    return df.withColumn("confidence", F.when(F.forall("originals", test), POSSIBLE).otherwise(F.col("confidence")))


def curate(resources: DataFrame, actions: list[Action]) -> DataFrame:
    """The actions in order; later ones override."""
    for a in actions:
        resources = a(resources)
    return resources
