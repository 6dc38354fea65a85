"""Curation of text corpora: ordered rejection, decontamination, dedup after acceptance, quotas, merging.

Rows carry `ord`, their place in the input; no result depends on the order of files or partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsieve.functions import text as T
from quillsieve.operators import checks


def free_name(columns, name: str) -> str:
    """A column name that no column has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(out)
    return out


def rejection(rows: DataFrame, rules: list[tuple[str, Column]], norm: Column, excluded: DataFrame | None = None, ord_col: str = "ord") -> DataFrame:
    """Adds norm and rejection. A row is `external_duplicate` if its text is excluded or an earlier row of it was
    accepted; that rule is judged first, but a rejected copy doesn't block a later one. The first accepted place
    of a text is an aggregate, so copies of one text never meet in a window."""
    # norm and rejection are results; what is needed on the way gets names that rows don't have
    kept = [c for c in rows.columns if c not in ("norm", "rejection")]
    key, failed, known, first = (free_name(rows.columns, f"_{n}") for n in ("key", "failed", "known", "first"))
    judged = rows.select(*kept, norm.alias("norm"), first_failure(rules).alias(failed)).withColumn(key, T.text_key(F.col("norm")))
    if excluded is None:
        judged = judged.withColumn(known, F.lit(False))
    else:
        keys = excluded.select(T.text_key(F.col("norm")).alias(key)).distinct().withColumn(known, F.lit(True))
        judged = judged.join(keys, key, "left").withColumn(known, F.coalesce(known, F.lit(False)))
    firsts = judged.filter(F.col(failed).isNull() & ~F.col(known)).groupBy(key).agg(F.min(ord_col).alias(first))
    joined = judged.join(firsts, key, "left")
    again = F.coalesce(F.col(known) | (F.col(ord_col) > F.col(first)), F.lit(False))
    return joined.select(*kept, "norm", F.when(again, "external_duplicate").otherwise(F.col(failed)).alias("rejection"))


def first_accepted(rows: DataFrame, norm: Column, ok: Column, ord_col: str = "ord") -> DataFrame:
    """Accepted rows, the first of each normalised text."""
    return rejection(rows, [("rejected", ~ok)], norm, ord_col=ord_col).filter("rejection is null")


def source_reason(rules: list[tuple[str, Column]], silent: Column | None = None):
    """Pre-filter of one source: rows outside its allowed set vanish uncounted, others carry their reason."""

    def apply(df: DataFrame) -> DataFrame:
        kept = df if silent is None else df.filter(~F.coalesce(silent, F.lit(False)))
        return kept.withColumn("reason", first_failure(rules))

    return apply


def apportion(quotas: dict[str, int], n: int) -> dict[str, int]:
    """n shared by quota: whole parts, then the largest remainders, ties by key."""
    if n <= 0:
        raise ValueError("the number of rows must be positive")
    total = sum(quotas.values())
    out = {k: n * q // total for k, q in quotas.items()}
    by_remainder = sorted(quotas, key=lambda k: (-(n * quotas[k] % total), k))
    for k in by_remainder[: n - sum(out.values())]:
        out[k] += 1
    return out


def apportioned(strata: DataFrame, key: str, amount: str, n: int) -> DataFrame:
    """(key, quota) as apportion() gives them, for a table of strata of any length: the largest remainders are a top-k."""
    if n <= 0:
        raise ValueError("the number of rows must be positive")
    total = strata.agg(F.sum(amount)).first()[0] or 1  # one number
    share = F.lit(n).cast("decimal(38,0)") * F.col(amount)
    parts = strata.select(key, F.floor(share / total).cast("bigint").alias("whole"), (share % total).alias("rest"))
    short = n - (parts.agg(F.sum("whole")).first()[0] or 0)
    more = parts.orderBy(F.desc("rest"), key).limit(short).select(F.col(key).alias("k"), F.lit(1).alias("more"))
    joined = parts.join(more, F.col(key).eqNullSafe(F.col("k")), "left")
    return joined.select(key, (F.col("whole") + F.coalesce("more", F.lit(0))).alias("quota"))


#: Rows of a small table up to which it is broadcast.
SMALL_TABLE = 100_000


def _maybe_broadcast(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL_TABLE else table


def quota_sample(rows: DataFrame, key: str, quotas: DataFrame, score: Column, ord_col: str) -> DataFrame:
    """The `quota` rows of least score of each stratum. quotas: (key, quota), one row a stratum. The rank
    filter becomes a group limit before the shuffle, so no stratum is sorted as a whole."""
    own, rank, most = (free_name(rows.columns, n) for n in ("_score", "_place", "_quota"))
    ranked = rows.withColumn(own, score).join(_maybe_broadcast(quotas.select(key, F.col("quota").alias(most))), key)
    largest = quotas.agg(F.max("quota")).first()[0] or 0  # one number
    place = F.row_number().over(Window.partitionBy(key).orderBy(own, ord_col))
    return ranked.withColumn(rank, place).filter((F.col(rank) <= largest) & (F.col(rank) <= F.col(most))).select(*rows.columns)


def short_strata(rows: DataFrame, key: str, quotas: DataFrame) -> DataFrame:
    """(key, quota, available) of strata with too few rows."""
    have = rows.groupBy(key).agg(F.count(F.lit(1)).alias("available"))
    return quotas.join(have, key, "left").select(key, "quota", F.coalesce("available", F.lit(0)).alias("available")).filter("available < quota")


def bottom_k(rows: DataFrame, score: Column, k: int, *ties: str) -> DataFrame:
    """The k rows of least score: a top-k plan, no full sort."""
    own = free_name(rows.columns, "_score")
    return rows.withColumn(own, score).orderBy(own, *ties).limit(k).drop(own)


def hash_split(rows: DataFrame, key: Column, ratio: float, excluded: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Rows whose hashed id falls below the ratio, without excluded ids."""
    kept = rows if excluded is None else rows.join(excluded, id_col, "left_anti")
    return kept.filter(T.unit_interval(key) < ratio)


def replicate(rows: DataFrame, key: str, repeats: DataFrame, default: int = 1) -> DataFrame:
    """Each row as often as its key's `repeats` say, with training_repeat from 1; ids after the first get a suffix."""
    times = free_name([*rows.columns, "training_repeat"], "_times")
    known = rows.join(_maybe_broadcast(repeats.select(key, F.col("repeats").alias(times))), key, "left")
    count = F.coalesce(F.col(times), F.lit(default)).cast("int")
    return known.select(*[c for c in rows.columns if c != "training_repeat"], F.explode(F.sequence(F.lit(1), count)).alias("training_repeat"))


def repeated_ids(*parts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n, kind) of ids that parts have more than once: `identical` copies, or `conflicting` ones, whose rows differ."""
    digest = [F.xxhash64(F.to_json(F.struct(*sorted(p.columns)), {"ignoreNullFields": "false"})) for p in parts]
    every = reduce(DataFrame.unionByName, [p.select(F.col(id_col).alias("id"), d.alias("digest")) for p, d in zip(parts, digest)])
    per = every.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return per.filter("n > 1").select("id", "n", F.when(F.col("low") == F.col("high"), "identical").otherwise("conflicting").alias("kind"))


def merge(parts: list[DataFrame], key: str, repeats: DataFrame, length: Column | None = None, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows of all parts, each as often as its key's repeats say. Ids must be unique over all parts, keys of the repeats
    known, and texts within the limit; conflicting copies are named before identical ones."""
    again = repeated_ids(*parts, id_col=id_col)
    checks.require_empty(again.filter("kind = 'conflicting'"), "conflicting rows of one id")
    checks.require_empty(again, "ids more than once")
    rows = reduce(DataFrame.unionByName, parts)
    if limit is not None:
        checks.require_empty(checks.too_long(rows, length, limit).select(id_col), f"rows longer than {limit}")
    checks.require_empty(checks.unknown_keys(repeats, rows.select(key).distinct(), key), f"unknown values of {key}")
    return replicate(rows, key, repeats)


def band_pool(pool: DataFrame, screened: DataFrame, training: DataFrame, low: int, high: int, strict: bool = False) -> DataFrame:
    """Pool rows whose screen has low..high correct samples and that aren't in the training set. strict: a screened row
    that the pool lacks is an error."""
    fit = screened.filter(F.col("n_correct").between(low, high)).select("id", "n_correct")
    if strict:
        checks.require_empty(checks.unknown_ids(fit, pool), "screened ids that the pool lacks")
    return pool.join(fit, "id").join(training.select("id"), "id", "left_anti")


def length_order(rows: DataFrame, length: Column, partitions: int) -> DataFrame:
    """Rows grouped by length over partitions, longest first."""
    own = free_name(rows.columns, "_length")
    return rows.withColumn(own, length).repartitionByRange(partitions, F.col(own).desc()).sortWithinPartitions(F.col(own).desc()).drop(own)


def last_write(rows: DataFrame, ord_col: str = "ord", id_col: str = "id") -> DataFrame:
    """The last row of each id."""
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*rows.columns), ord_col).alias("row")).select("row.*")


def first_rows(rows: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """The first n rows in input order."""
    return rows.orderBy(ord_col).limit(n)


def support_range(rows: DataFrame, low: int | None = None, high: int | None = None, column: str = "support") -> DataFrame:
    """Rows whose support lies within the bounds given; a missing support is 0."""
    n, out = F.coalesce(F.col(column), F.lit(0)), rows
    if low is not None:
        out = out.filter(n >= low)
    return out if high is None else out.filter(n <= high)
