"""The first stages of the chain rebuilt from raw texts: voters and samples are parsed again with a chosen extractor, tool
pools are picked by band, and the stages can be held against golden submissions.

Of one pool's spellings of an answer the last one's count stands. A band in its risky form asks for a sample without a
committed answer and takes any unique top answer; in its usual form it has a least number of votes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.operators import checks, gates
from quillsieve.operators import votes as V
from quillsieve.sources import readers

EXTRACTORS = {"boxed_first": T.extract_boxed_first, "final_first": T.extract_final_first}
STAGES = ("voters", "samples", "low", "middle")


@dataclass(frozen=True)
class Files:
    """File names by role; the first voter is the fallback."""

    voters: tuple[str, ...] = ("voter_1.jsonl", "voter_2.jsonl", "voter_3.jsonl", "voter_4.jsonl", "voter_5.jsonl")
    samples: tuple[str, ...] = ("samples.jsonl",)
    low_tools: str = "tools_low.jsonl"
    middle_tools: str = "tools_middle.jsonl"


@dataclass(frozen=True)
class Rules:
    sample_votes: int = 4
    low_votes: int = 2
    middle_votes: int = 4
    chain: gates.ChainConfig = gates.ChainConfig()


def rebuild(spark: SparkSession, problems: DataFrame, folder: str, extractor: str = "boxed_first", risky_bands: tuple[str, ...] = (), files: Files = Files(), rules: Rules = Rules()) -> DataFrame:
    """(ord, id, support, votes, nrisky, voters, samples, low, middle) of problems (ord, id)."""
    checks.require_parameters(extractor=extractor in EXTRACTORS, risky_bands=set(risky_bands) <= {"low", "middle"})
    parsed = lambda c: T.canonical(EXTRACTORS[extractor](c))
    one = F.lit(1).cast("bigint")

    def lines(name: str, schema: str) -> DataFrame:
        return readers.read_pools(spark, [f"{folder.rstrip('/')}/{name}"], f"id string, {schema}", optional=False)

    def counted(rows: DataFrame, pool: str, answer: Column, n: Column = one) -> DataFrame:
        return rows.select("id", F.lit(pool).alias("pool"), answer.alias("answer"), n.alias("n"))

    parts = []
    for k, name in enumerate(files.voters):
        said = lines(name, "response string").select("id", parsed(F.col("response")).alias("a"))
        parts += [counted(said, "voters", F.col("a"))] + ([counted(said, "own", F.col("a"))] if not k else [])
    for name in files.samples:
        rows = lines(name, "responses array<string>, sample_predictions array<string>")
        there = F.size("responses") > 0
        texts = rows.filter(there).select("id", F.explode("responses").alias("t"))
        parts += [counted(texts, "samples", parsed(F.col("t"))), counted(texts.filter(T.risky(F.col("t"))), "risky", F.lit(""))]
        parts.append(counted(rows.filter(~F.coalesce(there, F.lit(False))).select("id", F.explode("sample_predictions").alias("p")), "samples", T.canonical(F.col("p"))))
    for pool, name in (("low", files.low_tools), ("middle", files.middle_tools)):
        spelled = lines(name, "verified_counts map<string,bigint>").select("id", F.posexplode("verified_counts").alias("ord", "answer", "n"))
        parts.append(counted(V.overwritten(spelled), pool, F.col("answer"), F.col("n")))
    per, c = V.pooled_tops(reduce(DataFrame.unionByName, parts), ("voters", "own", "samples", "risky", "low", "middle")), F.col
    wide = problems.select("ord", F.col("id").cast("string").alias("id")).join(per, "id", "left")
    clear = F.coalesce(~c("voters.ties") & (c("voters.support") >= 2), F.lit(False))
    zero = F.lit(0)
    wide = wide.select(
        "ord", "id", F.coalesce("voters.support", zero).alias("support"), F.coalesce("samples.support", zero).alias("votes"), F.coalesce("risky.total", zero).alias("nrisky"),
        F.when(clear, c("voters.top")).otherwise(c("own.top")).alias("voters"), V.single_top(c("samples"), rules.sample_votes).alias("pick"),
        *[V.single_top(c(b), least).alias(name) for b, usual in (("low", rules.low_votes), ("middle", rules.middle_votes)) for name, least in ((f"{b}_usual", usual), (f"{b}_any", 1))],
    )
    picks = {b: (c(f"{b}_usual"), c(f"{b}_any")) for b in ("low", "middle")}
    nothing = (F.lit(None).cast("string"),) * 2
    gate = lambda current, low, middle: gates.tool_gate(c(current), c("votes"), c("nrisky"), low, middle, risky_bands, rules.chain)
    wide = wide.withColumn("samples", gates.sample_gate(c("voters"), c("support"), c("pick"), rules.chain))
    wide = wide.withColumn("low", gate("samples", picks["low"], nothing)).withColumn("middle", gate("low", nothing, picks["middle"]))
    return wide.select("ord", "id", "support", "votes", "nrisky", *STAGES)


def verify(spark: SparkSession, rebuilt: DataFrame, golden: dict[str, str]) -> dict[str, DataFrame]:
    """For each stage with a golden submission (stage to path) the ids whose answers differ."""
    checks.require_parameters(**{f"stage_{s}": s in STAGES for s in golden})
    return {s: checks.mismatches(rebuilt.select("id", F.col(s).alias("answer")), readers.read_answers(spark, path)) for s, path in golden.items()}
