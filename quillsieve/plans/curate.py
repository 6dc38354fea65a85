"""The curation job: candidates of several sources are pre-filtered, judged by ordered rules, chosen by quota and given with
a manifest.

A text that an earlier row of any source was accepted with is a duplicate; sources come in order, and rows in the
order of their source. Rejections are counted by reason over all sources.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.functions import udfs
from quillsieve.operators import checks, curation, nearness
from quillsieve.plans.scratch import stored


@dataclass(frozen=True)
class Source:
    """rows: ord, id, question, solution (the text that tokens are counted of) and the quota key. silent: rows that aren't of
    this source and vanish uncounted. reasons: pre-filters (reason, condition), the first that holds."""

    name: str
    rows: DataFrame
    quotas: dict[str, int]
    quota_key: str
    reasons: tuple[tuple[str, Column], ...] = ()
    silent: Column | None = None


@dataclass(frozen=True)
class Limits:
    least_tokens: int = 64
    most_tokens: int = 900
    most_sequence: int = 2048


def judge(sources: list[Source], official: DataFrame, excluded: DataFrame | None = None, limits: Limits = Limits(), tokens: udfs.TokenCounter = udfs.count_words, sequence: Column | None = None, sequences: bool = True) -> DataFrame:
    """(source, place, id, question, solution, stratum, n_tokens, norm, rejection) of all rows that aren't silent.
    official: text; excluded: norm, of texts that count as known."""
    parts = []
    for k, s in enumerate(sources):
        rows = curation.source_reason(list(s.reasons), s.silent)(s.rows)
        parts.append(rows.select(F.lit(s.name).alias("source"), F.struct(F.lit(k).alias("k"), F.col("ord")).alias("place"), "id", "question", "solution", F.col(s.quota_key).cast("string").alias("stratum"), "reason"))
    every = reduce(DataFrame.unionByName, parts)
    early = every.filter("reason is not null")
    # what the rules look at is made once a row, and written, since rows are read for the first accepted places and for the verdicts
    rows = every.filter("reason is null").drop("reason").withColumns({"n_tokens": tokens(F.col("solution")), "norm": T.normalized(F.col("question")), "_visual": F.col("question").rlike(T.VISUAL)})
    rows = stored(rows.withColumn("_long", F.lit(False) if sequence is None else F.coalesce(sequence > limits.most_sequence, F.lit(False))))
    # each row is judged by its own text, whatever its id; a text is judged once, and only if it is empty or alike in length
    words = rows.select(F.filter(F.split(F.coalesce("norm", F.lit("")), " "), lambda w: w != "").alias("tokens"))
    some = nearness.alike_in_length(words, official.select(T.tokens(F.col("text")).alias("tokens")), empty=True)
    texts = stored(some.groupBy(T.text_key(F.array_join("tokens", " ")).alias("key")).agg(F.any_value("tokens").alias("tokens")))
    known = stored(nearness.text_contamination(texts, official, sequences, stored).select(F.col("key").alias("_key"), F.concat(F.lit("official_"), "contamination").alias("official")))
    rows = rows.withColumn("_key", T.text_key(F.coalesce("norm", F.lit("")))).join(known, "_key", "left").drop("_key")
    rules = [("visual_or_url", F.col("_visual"))]
    rules += [(f"official_{kind}", F.col("official") == f"official_{kind}") for kind in ("empty", "exact", "near_token", "near_sequence")]
    rules += [("solution_too_short", F.col("n_tokens") < limits.least_tokens), ("solution_too_long", F.col("n_tokens") > limits.most_tokens)]
    rules.append(("sequence_too_long", F.col("_long")))
    judged = curation.rejection(rows, rules, F.col("norm"), excluded, "place").drop("official", "_visual", "_long")
    early = early.select("source", "place", "id", "question", "solution", "stratum", F.lit(None).cast("int").alias("n_tokens"), T.normalized(F.col("question")).alias("norm"), F.concat("source", F.lit("_"), "reason").alias("rejection"))
    return stored(judged.unionByName(early))


def choose(judged: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """The accepted rows of least score within the quotas of their source; a quota that can't be met is an error."""
    chosen = []
    for s in sources:
        quotas = judged.sparkSession.createDataFrame(list(s.quotas.items()), "stratum string, quota int")
        mine = judged.filter((F.col("source") == s.name) & F.col("rejection").isNull())
        checks.require_empty(curation.short_strata(mine, "stratum", quotas), f"strata of {s.name} with too few rows")
        chosen.append(curation.quota_sample(mine, "stratum", quotas, T.stable_score(seed, s.name, F.col("question")), "place"))
    return reduce(DataFrame.unionByName, chosen)


def counted(judged: DataFrame, chosen: DataFrame, seed: int) -> dict:
    """Sections of the manifest: rejections by reason, rows by source and stratum, tokens of the chosen."""
    strata: dict[str, dict[str, int]] = {}
    for r in chosen.groupBy("source", "stratum").count().collect():  # a row a stratum
        strata.setdefault(r["source"], {})[r["stratum"]] = r["count"]
    reasons = {r["rejection"]: r["count"] for r in judged.filter("rejection is not null").groupBy("rejection").count().collect()}  # a row a reason
    n = chosen.agg(F.min("n_tokens").alias("minimum"), F.avg("n_tokens").alias("average"), F.max("n_tokens").alias("maximum")).first()
    return {"seed": seed, "rejections": reasons, "chosen": strata, "tokens": n.asDict()}
