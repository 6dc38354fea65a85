"""Checks: each gives the violations as a frame; require_empty() turns them into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckError(ValueError):
    pass


def require_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    rows = violations.limit(shown).collect()  # a few examples
    if rows:
        raise CheckError(f"{message}: {[r.asDict() for r in rows]}")


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def id_differences(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, side): ids of one input only, by one aggregate over both. A null id equals none, so it is missing and extra."""
    sides = [df.select(id_col, F.lit(k == 0).alias("_a"), F.lit(k == 1).alias("_b")) for k, df in enumerate((a, b))]
    seen = sides[0].unionByName(sides[1]).groupBy(id_col).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    unknown = F.col(id_col).isNull()
    told = [F.when(F.col("_a") & (~F.col("_b") | unknown), F.lit("missing")), F.when(F.col("_b") & (~F.col("_a") | unknown), F.lit("extra"))]
    return seen.select(id_col, F.explode(F.array_compact(F.array(*told))).alias("side"))


def same_order(a: DataFrame, b: DataFrame, ord_col: str = "ord", id_col: str = "id") -> bool:
    """Whether ids come at the same places; a difference is a warning, not an error."""
    return a.select(id_col, F.col(ord_col).alias("_a")).join(b.select(id_col, F.col(ord_col).alias("_b")), id_col).filter("not _a <=> _b").isEmpty()


def non_integers(df: DataFrame, column: str = "answer") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).cast("string").rlike(r"^-?\d+$"), F.lit(False)))


def gold_conflicts(long: DataFrame, gold: str = "answer", id_col: str = "id") -> DataFrame:
    """Ids whose voters disagree on the gold answer."""
    return long.groupBy(id_col).agg(F.min(gold).alias("a"), F.max(gold).alias("b"), F.count_if(F.col(gold).isNull()).alias("none"), F.count(F.lit(1)).alias("n")).filter("a <> b or (none > 0 and none < n)").select(id_col)


def require_count(df: DataFrame, expected: int) -> None:
    n = df.count()
    if n != expected:
        raise CheckError(f"{n} rows instead of {expected}")


def unknown_ids(selected: DataFrame, population: DataFrame, id_col: str = "id") -> DataFrame:
    return selected.select(id_col).distinct().join(population, id_col, "left_anti")


def bad_chats(df: DataFrame, column: str = "messages", roles: tuple[str, ...] = ("system", "user", "assistant")) -> DataFrame:
    return df.filter(~F.coalesce(F.transform(column, lambda m: m["role"]) == F.array(*map(F.lit, roles)), F.lit(False)))


def too_long(df: DataFrame, length, limit: int) -> DataFrame:
    return df.filter(length > limit)


def missing_answers(df: DataFrame, column: str = "answer") -> DataFrame:
    return df.filter(F.col(column).isNull())


def unknown_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(known, key, "left_anti")


def require_columns(df: DataFrame, *columns: str) -> None:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise CheckError(f"missing columns {lacking}; there are {df.columns}")


def require_parameters(**conditions: bool) -> None:
    wrong = [name for name, holds in conditions.items() if not holds]
    if wrong:
        raise CheckError(f"invalid parameters: {wrong}")


def mismatches(rebuilt: DataFrame, golden: DataFrame, id_col: str = "id", column: str = "answer") -> DataFrame:
    """Ids whose rebuilt answer differs from the golden one."""
    return rebuilt.select(id_col, F.col(column).alias("rebuilt")).join(golden.select(id_col, F.col(column).alias("golden")), id_col, "full").filter("not rebuilt <=> golden")
