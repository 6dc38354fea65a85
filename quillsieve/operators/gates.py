"""Gated overrides: one wide row per id, each gate one conditional column after pre-aggregated left joins.

A gate reads only the current answer of its own row, so a chain of gates is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.operators.votes import votes_for


@dataclass(frozen=True)
class ChainConfig:
    """Thresholds; the defaults are those of the composed chain."""

    sample_support: int = 4
    low_votes: int = 3
    middle_votes: tuple[int, ...] = (4, 5)
    middle_risky: int = 1
    mode_support: int = 4
    pointer_votes: int = 4
    pointer_repeats: int = 2


def override(current: Column, new: Column, when: Column) -> Column:
    """`new` where the condition holds and there is a new answer, else the current one."""
    return F.when(F.coalesce(when, F.lit(False)) & new.isNotNull(), new).otherwise(current)


def guard(counts: Column, current: Column, new: Column) -> Column:
    """Veto: the code pool knows the id and gives the current answer more votes than the new one."""
    return counts.isNotNull() & (votes_for(counts, current) > votes_for(counts, new))


def sample_gate(current: Column, support: Column, sample_pick: Column, config: ChainConfig = ChainConfig()) -> Column:
    return override(current, sample_pick, support == config.sample_support)


def pool_gate(current: Column, votes: Column, nrisky: Column, low_pick: Column, middle_pick: Column, config: ChainConfig = ChainConfig()) -> Column:
    """Low bands take the pick of their pool, middle ones theirs if enough samples are risky. No samples are 0 votes."""
    n = F.coalesce(votes, F.lit(0))
    low = override(current, low_pick, n <= config.low_votes)
    middle = n.isin(*config.middle_votes) & (F.coalesce(nrisky, F.lit(0)) >= config.middle_risky)
    return override(low, middle_pick, middle)


def tool_gate(current: Column, votes: Column, nrisky: Column, low: tuple[Column, Column], middle: tuple[Column, Column], risky_bands: tuple[str, ...] = (), config: ChainConfig = ChainConfig()) -> Column:
    """Tool answers of the low and the middle band. Of a pair of picks the first has the band's usual least number of
    votes; the second, of any number, is taken in the risky form of a band, where some sample must be risky."""
    n, risk = F.coalesce(votes, F.lit(0)), F.coalesce(nrisky, F.lit(0)) >= config.middle_risky
    out = current
    for name, inside, (usual, any_pick) in (("low", n <= config.low_votes, low), ("middle", n.isin(*config.middle_votes), middle)):
        out = override(out, any_pick, inside & risk) if name in risky_bands else override(out, usual, inside)
    return out


def mode_gate(current: Column, support: Column, mode: Column, counts: Column, config: ChainConfig = ChainConfig()) -> Column:
    new = (support <= config.mode_support) & ~mode.eqNullSafe(current) & ~guard(counts, current, mode)
    return override(current, mode, new)


def concentration_gate(current: Column, mode: Column, counts: Column) -> Column:
    return override(current, mode, ~mode.eqNullSafe(current) & ~guard(counts, current, mode))


def pointer_gate(current: Column, pointer: Column, pool: Column, repeats: Column, config: ChainConfig = ChainConfig()) -> Column:
    """`pool` and `repeats` are maps of counts; missing current answers have the count of missing samples, given as ''."""
    new, old = votes_for(pool, pointer), votes_for(pool, current)
    fires = ~pointer.eqNullSafe(current) & (new >= config.pointer_votes) & (new > old) & (votes_for(repeats, pointer) >= config.pointer_repeats)
    return override(current, pointer, fires)


def chain(wide: DataFrame, config: ChainConfig = ChainConfig()) -> DataFrame:
    """Adds c1 .. c4 to rows of base, support, sample_pick, votes, nrisky, low_pick, middle_pick, mode,
    code_counts, pointer, pool and repeats."""
    c = F.col
    return (
        wide.withColumn("c1", sample_gate(c("base"), c("support"), c("sample_pick"), config))
        .withColumn("c2", pool_gate(c("c1"), c("votes"), c("nrisky"), c("low_pick"), c("middle_pick"), config))
        .withColumn("c3", mode_gate(c("c2"), c("support"), c("mode"), c("code_counts"), config))
        .withColumn("c4", pointer_gate(c("c3"), c("pointer"), c("pool"), c("repeats"), config))
    )


def bands(support: Column, votes: Column, nrisky: Column, config: ChainConfig = ChainConfig()) -> dict[str, Column]:
    """Boolean columns of the bands that later stages sample for."""
    n = F.coalesce(votes, F.lit(0))
    return {
        "vote3": n <= config.low_votes,
        "vote45": n.isin(*config.middle_votes) & (F.coalesce(nrisky, F.lit(0)) >= config.middle_risky),
        "support4": F.coalesce(support, F.lit(0)) <= config.mode_support,
        "vote5": n <= max(config.middle_votes),
    }
