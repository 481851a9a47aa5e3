"""N-grams, identifiers and similarity predicates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_ngrams(c: Column, n: int = 2) -> Column:
    """All character n-grams with repeats; none for a shorter string."""
    last = F.length(c) - F.lit(n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: c.substr(i, F.lit(n)))
    )


def word_ngrams(c: Column, n: int = 2) -> Column:
    """All word n-grams, words being what single spaces separate."""
    words = F.split(c, " ", -1)
    last = F.size(words) - F.lit(n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    )


def context_grams(c: Column) -> Column:
    """Words, word pairs, character pairs and triples: the features of context scoring."""
    return F.concat(word_ngrams(c, 1), word_ngrams(c, 2), char_ngrams(c, 2), char_ngrams(c, 3))


def strip_uri(c: Column) -> Column:
    """The last part of a URI's path; strings without a scheme stay as they are."""
    path = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.element_at(F.split(path, "/", -1), -1)).otherwise(c)


def curie_parts(c: Column, names: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(source, id) of ``source:id``, the source renamed where ``names`` has it."""
    parts = F.split(c, ":", 2)
    source = F.element_at(parts, 1)
    for old, new in (names or {}).items():
        source = F.when(F.element_at(parts, 1) == old, F.lit(new)).otherwise(source)
    return source, F.try_element_at(parts, F.lit(2))


def id_source(c: Column, separator: str = "_") -> Column:
    """The source that an identifier names: what comes before the first separator."""
    return F.substring_index(c, separator, 1)


def numbers_match(a: Column, b: Column) -> Column:
    """The same numbers, as often, in both strings."""
    found = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)))
    return found(a) == found(b)


def subtypes_match(reference: Column, query: Column) -> Column:
    """Every ``TYPE n`` of the reference comes at least as often in the query."""
    found = lambda c: F.regexp_extract_all(c, F.lit("(TYPE (?:I|[0-9]+))"), F.lit(1))
    ref, qry = found(reference), found(query)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.forall(ref, lambda x: count(qry, x) >= count(ref, x))


MODIFIERS = ("LIKE", "SUBUNIT", "PSEUDOGENE", "RECEPTOR")


def modifiers_match(a: Column, b: Column, phrases: tuple[str, ...] = MODIFIERS) -> Column:
    """Each phrase is in both strings or in neither."""
    out = F.lit(True)
    for p in phrases:
        out = out & (a.contains(p) == b.contains(p))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def edit_ratio(a: Column, b: Column) -> Column:
    """100 for equal strings, less by the share of edits: a stand-in for fuzzy ratios."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / n))
