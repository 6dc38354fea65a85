"""Vote algebra on the long relation votes(id, idx, answer[, weight]); answers are canonical strings.

A tie for the top shows as two different answers with the largest and smallest name among those of the top
count, so every decision is one aggregate per (id, answer) and one per id: partial aggregation works on
both and no list of a group is built. Nothing depends on the order of rows or maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.text import canonical


def explode_votes(df: DataFrame, votes_col: str, id_col: str = "id") -> DataFrame:
    """Long form of an array column; idx counts from 0, nulls stay."""
    return df.select(F.col(id_col).alias("id"), F.posexplode_outer(votes_col).alias("idx", "answer"))


def histogram(votes: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, answer, n) without null answers."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    return votes.filter("answer is not null").groupBy("id", "answer").agg(amount.alias("n"))


def tops(hist: DataFrame) -> DataFrame:
    """(id, top, support, ties, total): a top answer, its count, whether another has as many, all votes."""
    high, low = F.max(F.struct("n", "answer")), F.min(F.struct((-F.col("n")).alias("m"), F.col("answer")))
    both = hist.groupBy("id").agg(high.alias("high"), low.alias("low"), F.sum("n").alias("total"))
    return both.select("id", F.col("high.answer").alias("top"), F.col("high.n").alias("support"), (F.col("high.answer") != F.col("low.answer")).alias("ties"), "total")


def pooled_tops(counts: DataFrame, tops: tuple[str, ...], maps: tuple[str, ...] = ()) -> DataFrame:
    """One row an id of counts(id, pool, answer, n), all pools at once: for each pool of `tops` a struct(top, support,
    ties, total) as in tops(), null without votes, and for each of `maps` its map answer -> n. The counts become one row an
    answer of an id, with a number for each pool; these rows move to their ids as they are, since the wide state of an id is
    several times as large as they are."""
    names = tuple(dict.fromkeys((*tops, *maps)))
    n = {name: F.col(f"n{k}") for k, name in enumerate(names)}
    # a filter of missing answers would go below the sums and make each answer a second time
    there = F.count("answer").alias("there")
    sums = counts.groupBy("id", "answer").agg(*[F.sum(F.when(F.col("pool") == name, F.col("n"))).alias(f"n{k}") for k, name in enumerate(names)], there).filter("there > 0").drop("there")
    parts = []
    for name in tops:
        there = n[name].isNotNull()
        parts.append(F.max(F.when(there, F.struct(n[name].alias("n"), "answer"))).alias(f"{name}_high"))
        parts.append(F.min(F.when(there, F.struct((-n[name]).alias("m"), "answer"))).alias(f"{name}_low"))
        parts.append(F.sum(n[name]).alias(f"{name}_total"))
    if maps:  # a row is as large as its id has answers
        parts.append(F.collect_list(F.struct("answer", *[n[name].alias(name) for name in maps])).alias("entries"))
    per = sums.repartition("id").groupBy("id").agg(*parts)
    out = [
        F.when(F.col(f"{name}_high").isNotNull(), F.struct(F.col(f"{name}_high.answer").alias("top"), F.col(f"{name}_high.n").alias("support"), (F.col(f"{name}_high.answer") != F.col(f"{name}_low.answer")).alias("ties"), F.col(f"{name}_total").alias("total"))).alias(name)
        for name in tops
    ]
    out += [_entry_map(name).alias(name if name not in tops else f"{name}_map") for name in maps]
    return per.select("id", *out)


def _entry_map(name: str) -> Column:
    """answer -> n of one pool, from an id's entries; null without votes."""
    mine = F.filter("entries", lambda e: e[name].isNotNull())
    made = F.map_from_entries(F.transform(mine, lambda e: F.struct(e["answer"].alias("answer"), e[name].alias("n"))))
    return F.when(F.exists("entries", lambda e: e[name].isNotNull()), made)


def single_top(pool: Column, min_count: int = 1) -> Column:
    """The answer of a struct of pooled_tops() if it is the only top one and has enough votes."""
    return F.when(~pool["ties"] & (pool["support"] >= min_count), pool["top"])


def majority(votes: DataFrame, fallback: int = 0) -> DataFrame:
    """(id, answer, support, decision): the single top answer of two votes or more, else the fallback voter's."""
    by = votes.groupBy("id", "answer").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("idx") == fallback).alias("own"))
    known = F.col("answer").isNotNull()
    per = by.groupBy("id").agg(
        F.max(F.when(known, F.struct("n", "answer"))).alias("high"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("m"), F.col("answer")))).alias("low"),
        F.max(F.when(F.col("own"), F.col("answer"))).alias("fallback"),
    )
    clear = (F.col("high.n") >= 2) & (F.col("high.answer") == F.col("low.answer"))
    return per.select(
        "id",
        F.when(clear, F.col("high.answer")).otherwise(F.col("fallback")).alias("answer"),
        F.coalesce(F.col("high.n"), F.lit(0)).alias("support"),
        F.when(clear, "majority").otherwise("fallback").alias("decision"),
    )


def choose(votes: DataFrame, fallback: int = 0, ignore_null: bool = False) -> DataFrame:
    """(id, answer, decision). Unless ignore_null, a missing answer is a candidate like any other; with it,
    a missing fallback moves to the first voter with an answer."""
    kind = "ignored" if ignore_null else "kept"
    return choices(votes, fallback).select("id", F.col(f"{kind}_answer").alias("answer"), F.col(f"{kind}_decision").alias("decision"))


def choices(votes: DataFrame, fallback: int = 0) -> DataFrame:
    """(id, kept_answer, kept_decision, ignored_answer, ignored_decision): both readings of missing answers, as
    candidates and as no votes, from the same sums."""
    by = votes.groupBy("id", "answer").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("idx") == fallback).alias("own"), F.min("idx").alias("first"))
    named = F.struct(F.col("answer").isNull().alias("missing"), F.coalesce("answer", F.lit("")).alias("name"))
    high, low = F.struct(F.col("n"), named.alias("of")), F.struct((-F.col("n")).alias("m"), named.alias("of"))
    there = F.col("answer").isNotNull()
    per = by.groupBy("id").agg(
        F.max(high).alias("kept_high"),
        F.min(low).alias("kept_low"),
        F.max(F.when(there, high)).alias("ignored_high"),
        F.min(F.when(there, low)).alias("ignored_low"),
        F.max(F.when(F.col("own"), F.col("answer"))).alias("fallback"),
        F.min(F.when(there, F.struct("first", "answer"))).alias("early"),
    )
    out = []
    for kind, spare in (("kept", F.col("fallback")), ("ignored", F.coalesce("fallback", "early.answer"))):
        top, other = F.col(f"{kind}_high"), F.col(f"{kind}_low")
        clear = F.coalesce((top["n"] >= 2) & (top["of"] == other["of"]), F.lit(False))
        out.append(F.when(clear, F.when(~top["of"]["missing"], top["of"]["name"])).otherwise(spare).alias(f"{kind}_answer"))
        out.append(F.when(clear, "majority").otherwise("fallback").alias(f"{kind}_decision"))
    return per.select("id", *out)


def pick(hist: DataFrame, min_count: int = 1, strict: bool = True) -> DataFrame:
    """(id, answer, n): the top answer of at least min_count votes, null when short or, if strict, tied. Without
    strict, a tie goes to the largest name."""
    enough = F.col("support") >= min_count
    return tops(hist).select("id", F.when(enough & ~F.col("ties") if strict else enough, F.col("top")).alias("answer"), F.col("support").alias("n"))


def concentration(hist: DataFrame, share: float = 0.425) -> DataFrame:
    """(id, answer, n, total): the single top answer with at least `share` of the votes, else null."""
    clear = ~F.col("ties") & (F.col("support") / F.col("total") >= share)
    return tops(hist).select("id", F.when(clear, F.col("top")).alias("answer"), F.col("support").alias("n"), "total")


def pooled(*pools: DataFrame) -> DataFrame:
    """Histogram over pools (id, answer, n): answers are made canonical and equal ones add up. Answers as they are
    spelled are summed first, so the patterns see each spelling of an id once."""
    every = pools[0].select("id", "answer", "n")
    for pool in pools[1:]:
        every = every.unionByName(pool.select("id", "answer", "n"))
    every = every.groupBy("id", "answer").agg(F.sum("n").alias("n"))
    return every.withColumn("answer", canonical(F.col("answer"))).filter("answer is not null").groupBy("id", "answer").agg(F.sum("n").alias("n"))


def overwritten(counts: DataFrame) -> DataFrame:
    """Histogram (id, answer, n) of counts (id, ord, answer, n) of one pool in which the last of the spellings of an
    answer stands for all of them, instead of their sum."""
    named = counts.withColumn("answer", canonical(F.col("answer"))).filter("answer is not null")
    return named.groupBy("id", "answer").agg(F.max_by("n", "ord").alias("n"))


def explode_counts(df: DataFrame, map_col: str, id_col: str = "id") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.explode(map_col).alias("answer", "n"))


def count_map(hist: DataFrame, name: str) -> DataFrame:
    """(id, name: map answer -> n); a row is as large as its id has answers."""
    return hist.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("answer", "n"))).alias(name))


def votes_for(counts: Column, answer: Column) -> Column:
    """Votes of an answer in a map of counts; 0 for a missing map, answer or entry."""
    return F.coalesce(F.try_element_at(counts, F.coalesce(answer, F.lit(""))), F.lit(0))


def verified(samples: DataFrame) -> DataFrame:
    """Histogram of the answers (id, prediction, status, output) whose program ran and printed the answer."""
    from quillsieve.functions.text import canonical_output

    same = (F.col("status") == "ok") & (canonical_output(F.col("output")) == F.col("prediction"))
    return samples.filter(same).groupBy("id", F.col("prediction").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def summary(hist: DataFrame) -> DataFrame:
    """(id, valid, answers, counts): answers by falling count, then by name, and how many votes there are."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("answer"))))
    per = hist.groupBy("id").agg(order.alias("order"), F.sum("n").alias("valid"))
    return per.select("id", "valid", F.transform("order", lambda s: s["answer"]).alias("answers"), F.transform("order", lambda s: -s["m"]).alias("counts"))


def unsettled(hist: DataFrame, ids: DataFrame, min_count: int = 2) -> DataFrame:
    """Ids without a single top answer of min_count votes: those that get more samples."""
    return ids.join(pick(hist, min_count).filter("answer is not null").select("id"), "id", "left_anti")
