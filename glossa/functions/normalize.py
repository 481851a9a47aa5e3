"""Normalisation of mention and synonym strings, by entity class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GREEK_NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def _greek() -> dict[str, str]:
    names = _GREEK_NAMES.split()
    upper = [chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2]
    lower = [chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2]
    table = dict(zip(upper, names)) | dict(zip(lower, names))
    return table | {"ϴ": "theta", "ϐ": "beta", "ϕ": "phi", "ς": "final sigma"}


GREEK = _greek()
#: In this order: longer numerals first. X stays, since it is often a letter.
SUBSTITUTIONS = (
    ("(", " ("), (")", ") "), (",", " "), ("/", " "),
    ("VIII", " 8 "), ("VII", " 7 "), ("XII", " 12 "), ("III", " 3 "), ("VI", " 6 "), ("IV", " 4 "), ("IX", " 9 "), ("XI", " 11 "), ("II", " 2 "),
)
#: Hyphens become spaces, but for those that touch a bracket from inside.
HYPHENS = ("-", "‐")
DISEASE_NOUNS = ("flu", "Flu", "HIV", "STI", "NSCLC")
GENE_ENDINGS = ("in", "ase", "an", "gen", "gon")


def _count(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", ""))


def uppers(c: Column) -> Column:
    return _count(c, r"\p{Lu}")


def letters(c: Column) -> Column:
    return _count(c, r"\p{L}")


def numerics(c: Column) -> Column:
    return _count(c, r"\p{N}")


def _mostly_symbols(c: Column) -> Column:
    """As many upper-case letters as others, or as many digits as letters."""
    up, all_ = uppers(c), letters(c)
    return (up >= all_ - up) | (numerics(c) >= all_)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_symbolic(c: Column) -> Column:
    """Whether a string looks like a symbol rather than a noun phrase."""
    single = F.instr(c, " ") == 0
    inner = c.rlike(r"(?s)^.+\p{Lu}") | c.rlike(r"\p{N}")
    return (single & ((F.length(c) <= 3) | inner)) | _mostly_symbols(c)


def replace_substrings(c: Column) -> Column:
    for old, new in SUBSTITUTIONS:
        c = F.replace(c, F.lit(old), F.lit(new))
    for h in HYPHENS:
        c = F.replace(F.replace(c, F.lit("(" + h), F.lit("(\u0001")), F.lit(h + ")"), F.lit("\u0001)"))
        c = F.replace(F.replace(c, F.lit(h), F.lit(" ")), F.lit("\u0001"), F.lit(h))
    c = F.regexp_replace(c, r"\sI\s|\sI$", " 1 ")
    return F.regexp_replace(c, r"\sV\s|\sV$", " 5 ")


def split_numbers(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s*(\d+)\s*", " $1 ")


def replace_greek(c: Column) -> Column:
    for letter, name in GREEK.items():
        c = F.replace(c, F.lit(letter), F.lit(f" {name.upper()} "))
    return c


def remove_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N} ()+\-‐]", "")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), 0)


def depluralize(c: Column) -> Column:
    """The singular of an English plural, for strings of more than three characters."""

    def singular(x: Column) -> Column:
        n = F.length(x)
        cut = lambda k: x.substr(F.lit(1), n - k)
        return (
            F.when((n <= 3) | ~x.endswith("s") | x.endswith("sis"), x)
            .when(x.endswith("oes"), cut(2))
            .when(x.endswith("ies"), F.concat(cut(3), F.lit("y")))
            .when(x.rlike("(xes|ses|ches|shes)$"), cut(2))
            .otherwise(cut(1))
        )

    return let(c, singular)


def expand_initials(c: Column) -> Column:
    c = F.regexp_replace(c, r"\sA\s|\sA$|^A\s", " ALPHA ")
    return F.regexp_replace(c, r"\sB\s|\sB$|^B\s", " BETA ")


def normalize_symbol(c: Column) -> Column:
    return collapse(F.upper(c))


def normalize_phrase(c: Column) -> Column:
    c = remove_marks(replace_greek(split_numbers(replace_substrings(c))))
    return collapse(F.upper(expand_initials(depluralize(c))))


def gene_is_symbolic(c: Column) -> Column:
    tokens = F.split(c, r"[-‐\s]+")
    ends = F.lit(False)
    for e in GENE_ENDINGS:
        ends = ends | c.endswith(e)
    token = lambda t: (F.length(t) < 4) | t.rlike(r"(?s)^\p{Ll}.*\p{Lu}") | _mostly_symbols(t)
    return ((F.size(tokens) == 1) & ~ends) | F.forall(tokens, token)


def gene_normalize_symbol(c: Column) -> Column:
    n = F.length(c)
    bare = F.when((n >= 3) & c.rlike(r"(?s)\p{Lu}s$"), c.substr(F.lit(1), n - 1)).otherwise(c)
    return collapse(F.upper(expand_initials(remove_marks(replace_greek(split_numbers(replace_substrings(bare)))))))


def disease_is_symbolic(c: Column) -> Column:
    return ~c.isin(*DISEASE_NOUNS) & is_symbolic(c)


def company_is_symbolic(c: Column) -> Column:
    return letters(c) == uppers(c)


def anatomy_is_symbolic(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(False))


_CLASSES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "gene": (gene_is_symbolic, gene_normalize_symbol),
    "disease": (disease_is_symbolic, normalize_symbol),
    "anatomy": (anatomy_is_symbolic, normalize_symbol),
    "company": (company_is_symbolic, F.upper),
}


def classify_symbolic(c: Column, entity_class: str | None = None) -> Column:
    """Whether the string is symbolic by the rules of its class (the default rules for other classes)."""
    return _CLASSES.get(entity_class or "", (is_symbolic, normalize_symbol))[0](c)


def normalize(c: Column, entity_class: str | None = None) -> Column:
    """The form that mentions and synonyms of a class are compared in; null stays null."""
    symbolic, symbol = _CLASSES.get(entity_class or "", (is_symbolic, normalize_symbol))
    return F.when(symbolic(c), symbol(c)).otherwise(normalize_phrase(c))


def normalize_by(c: Column, cls: Column) -> Column:
    """``normalize`` where the class is a column; the long chain for phrases is there once."""
    symbol = F.when(cls == "gene", gene_normalize_symbol(c)).when(cls == "company", F.upper(c)).otherwise(normalize_symbol(c))
    return F.when(symbolic_by(c, cls), symbol).otherwise(normalize_phrase(c))


def symbolic_by(c: Column, cls: Column) -> Column:
    """``classify_symbolic`` where the class is a column."""
    out = F.when(cls == "gene", gene_is_symbolic(c)).when(cls == "anatomy", F.lit(False)).when(cls == "company", company_is_symbolic(c))
    return out.otherwise(is_symbolic(c) & ~((cls == "disease") & c.isin(*DISEASE_NOUNS)))
