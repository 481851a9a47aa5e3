"""The strategy cascade: confident mentions first, phrases before symbols, strategy by strategy."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strategies import PER, single

Filter = Callable[[DataFrame], DataFrame]
#: (sets, mapped so far) -> sets; a key is settled where exactly one set is left.
Disambiguation = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Strategy:
    """Which links to keep, then how to choose among their id sets.

    Not essential: one set needs no choice, and if no choice succeeds all sets are mapped as AMBIGUOUS.
    """

    name: str
    keep: Filter
    choose: Sequence[tuple[str, Disambiguation]] = ()
    essential: bool = False
    confidence: str = "HIGHLY_LIKELY"


@dataclass(frozen=True)
class Level:
    confidence: int
    symbolic: bool
    strategies: Sequence[Strategy] = field(default=())


def run(
    links: DataFrame,
    sets: DataFrame,
    levels: Sequence[Level],
    stop_on_success: bool = True,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """key, doc_id, parser, idx, strategy, confidence, disambiguation: mappings of the mention keys.

    ``links`` has key, doc_id, parser, confidence, symbolic and what the strategies read; ``sets`` has
    key, doc_id, parser, syn_norm, set_key, idx. A pass sees the mappings of the passes before it, never
    of its own. A parser is resolved for a key by its first mapping; with ``stop_on_success`` the whole
    key is. ``cut`` may materialise what a pass starts from and makes, so plans stay short; passes without
    links are skipped.
    """
    done: DataFrame | None = None
    for level in levels:
        todo_level = links.filter((F.col("confidence") == level.confidence) & (F.col("symbolic") == level.symbolic))
        for strategy in level.strategies:
            todo = todo_level
            if done is not None:
                todo = todo.join(done.select(*(["key"] if stop_on_success else PER)).distinct(), ["key"] if stop_on_success else PER, "left_anti")
            kept = strategy.keep(todo).select("key", "parser", "syn_norm").distinct()
            own = cut(sets.join(kept, ["key", "parser", "syn_norm"], "left_semi"))
            if done is not None and own.isEmpty():
                continue
            new = _settle(own, strategy, done, cut)
            done = cut(new if done is None else done.unionByName(new))
    if done is None:
        raise ValueError("no strategies")
    return done


def _settle(own: DataFrame, strategy: Strategy, done: DataFrame | None, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    def out(df: DataFrame, how: str, sure: str | None) -> DataFrame:
        return df.select(
            "key", "doc_id", "parser", "idx", F.lit(strategy.name).alias("strategy"), F.lit(strategy.confidence).alias("confidence"),
            F.lit(how).alias("disambiguation"), F.lit(sure).cast("string").alias("disambiguation_confidence"),
        ).distinct()

    found: list[DataFrame] = []
    rest = own
    if not strategy.essential:
        one = single(rest)
        found.append(out(one, "not_required", None))
        rest = cut(rest.join(one.select(*PER).distinct(), PER, "left_anti"))
    for name, choose in strategy.choose:
        # Before anything is mapped, nothing is defined elsewhere in a document.
        mapped = done if done is not None else own.limit(0)
        one = cut(single(choose(rest, mapped)))
        found.append(out(one, name, "HIGHLY_LIKELY"))
        rest = cut(rest.join(one.select(*PER).distinct(), PER, "left_anti"))
    if not strategy.essential:
        found.append(out(rest, "none", "AMBIGUOUS"))
    result = found[0] if found else out(own.limit(0), "none", None)
    for f in found[1:]:
        result = result.unionByName(f)
    return result
