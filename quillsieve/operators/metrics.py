"""Scores, stage deltas, histograms and manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correct(prediction: Column, gold: Column, raw: bool = False) -> Column:
    """Null-safe equality; `raw` compares strings as they are, else answers count as integers."""
    from quillsieve.functions.text import canonical

    return prediction.eqNullSafe(gold) if raw else canonical(prediction).eqNullSafe(canonical(gold))


def accuracy(df: DataFrame, prediction: str = "prediction", gold: str = "answer") -> DataFrame:
    """(total, correct, accuracy) over rows with gold."""
    hit = F.col(prediction).eqNullSafe(F.col(gold))
    return df.filter(F.col(gold).isNotNull()).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"))


def voter_accuracy(votes: DataFrame, gold: DataFrame) -> DataFrame:
    """(idx, correct, total) of each voter of votes(id, idx, answer) against gold(id, gold)."""
    return votes.join(gold, "id").groupBy("idx").agg(F.count_if(F.col("answer").eqNullSafe(F.col("gold"))).alias("correct"), F.count(F.lit(1)).alias("total"))


def decision_counters(chosen: DataFrame, votes: DataFrame, fallback: int = 0, abstained: Column | None = None) -> DataFrame:
    """How ids were decided: majority_resolved, fallback_used, changed_from_fallback, abstained_total."""
    own = votes.filter(F.col("idx") == fallback).select("id", F.col("answer").alias("own"))
    counted = chosen.join(own, "id", "left").agg(
        F.count_if(F.col("decision") == "majority").alias("majority_resolved"),
        F.count_if(F.col("decision") == "fallback").alias("fallback_used"),
        F.count_if(~F.col("answer").eqNullSafe(F.col("own"))).alias("changed_from_fallback"),
    )
    lost = votes.agg(F.count_if(abstained if abstained is not None else F.lit(False)).alias("abstained_total"))
    return counted.withColumn("_k", F.lit(1)).join(lost.withColumn("_k", F.lit(1)), "_k").drop("_k")


def retry_counters(df: DataFrame) -> DataFrame:
    """recovered and regressed of rows with initial_ok and final_ok."""
    a, b = F.coalesce("initial_ok", F.lit(False)), F.coalesce("final_ok", F.lit(False))
    return df.agg(F.count_if(~a & b).alias("recovered"), F.count_if(a & ~b).alias("regressed"))


def pass_rate(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, num_samples, n_correct, pass_rate, truncated) of samples(id, answer, truncated); without gold nothing is correct."""
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    joined = samples.join(gold, "id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("num_samples"), F.count_if(hit).alias("n_correct"), F.count_if("truncated").alias("truncated"))
    return joined.withColumn("pass_rate", F.col("n_correct") / F.col("num_samples"))


def oracle(df: DataFrame, votes_col: str, gold: str = "answer", id_col: str = "id") -> DataFrame:
    """(id, hit): whether any sample is the gold answer."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.array_contains(votes_col, F.col(gold)), F.lit(False)).alias("hit"))


def stage_delta(wide: DataFrame, stages: list[str], gold: str = "gold") -> DataFrame:
    """(stage, total, correct, changed, gained, regressed, net): each stage against the one before it. Changes
    count all ids, scores those with gold. All stages are sums of one scan of the wide rows."""
    have = F.col(gold).isNotNull()
    sums, rows = [], []
    for k, stage in enumerate(stages):
        now, was = F.col(stage), F.col(stages[max(k - 1, 0)])
        ok, before = have & now.eqNullSafe(F.col(gold)), have & was.eqNullSafe(F.col(gold))
        for name, c in (("correct", ok), ("changed", ~now.eqNullSafe(was)), ("gained", ok & ~before), ("regressed", before & ~ok)):
            sums.append(F.count_if(c).alias(f"{name}_{k}"))
        rows.append(F.struct(F.lit(stage).alias("stage"), F.col("total"), *[F.col(f"{n}_{k}").alias(n) for n in ("correct", "changed", "gained", "regressed")]))
    wide = wide.agg(F.count_if(have).alias("total"), *sums)
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("net", F.col("gained") - F.col("regressed"))


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    return df.select(length.alias("_l")).agg(F.min("_l").alias("min_tokens"), F.avg("_l").alias("avg_tokens"), F.max("_l").alias("max_tokens"))


def reward(prediction: Column, gold: Column) -> Column:
    """1.0 for the extracted integer being the gold one, commas apart."""
    from quillsieve.functions.text import strip

    return F.when(prediction.eqNullSafe(F.replace(strip(gold), F.lit(","), F.lit(""))), 1.0).otherwise(0.0)


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of a table's rows that doesn't depend on their order; copies count."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.sum(F.col("h").cast("decimal(20,0)")).cast("string"), 256).alias("digest"))


def throughput(done: int, total: int, seconds: float) -> dict[str, float]:
    rate = done / seconds if seconds > 0 else 0.0
    return {"done": done, "total": total, "per_second": rate, "eta_seconds": (total - done) / rate if rate else float("inf")}


def manifest(**sections) -> str:
    """Pretty JSON of counts, digests and quotas."""
    return json.dumps(sections, ensure_ascii=False, indent=2, sort_keys=True, default=str)
