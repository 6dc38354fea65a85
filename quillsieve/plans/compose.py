"""From a folder of materials to one answer a problem: voters, samples, tool pools, screened samples and pointers are read,
counted in one long relation, and put through the chain of gates. Stages can be emitted as submissions.

Materials are JSON lines by problem id; `bands` is one JSON object of maps by id. Tool pools that are missing are skipped,
every other material must be there, and each problem must have its bands.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.operators import checks, gates, metrics
from quillsieve.operators import votes as V
from quillsieve.operators.rollouts import round_store
from quillsieve.plans.scratch import scratch_folder, stored
from quillsieve.sources import jsondoc, readers, sinks

#: Maps of the bands file.
BANDS = ("support", "votes", "nrisky")
PLAIN_ENTRY = r'^"[^"\\\x00-\x1f]*"\s*:\s*(?:0|-?[1-9][0-9]{0,17})\z'
STAGES = ("base", "c1", "c2", "c3", "c4")


@dataclass(frozen=True)
class Materials:
    """File names by role. The first voter is the fallback; the guard's pools are those of both bands unless named."""

    voters: tuple[str, ...] = ("voter_1.jsonl", "voter_2.jsonl", "voter_3.jsonl", "voter_4.jsonl", "voter_5.jsonl")
    bands: str = "bands.json"
    samples: str = "samples.jsonl"
    low_pools: tuple[str, ...] = ("tools_low.jsonl",)
    middle_pools: tuple[str, ...] = ("tools_middle.jsonl",)
    guard_pools: tuple[str, ...] = ()
    screened: str = "screened.jsonl"
    pointer: str = "pointer.jsonl"
    repeats: str = "pointer_repeats.jsonl"
    pointer_pools: tuple[str, ...] = ("pointer_pool_1.jsonl", "pointer_pool_2.jsonl")


@dataclass(frozen=True)
class Rules:
    """Least counts of the picks, and the thresholds of the gates."""

    sample_votes: int = 4
    tool_votes: int = 2
    mode_votes: int = 5
    chain: gates.ChainConfig = field(default_factory=gates.ChainConfig)


def _one(rows: DataFrame, pool: str, answer: Column, n: Column | None = None) -> DataFrame:
    return rows.select("id", F.lit(pool).alias("pool"), answer.alias("answer"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))


def counts(spark: SparkSession, folder: str, names: Materials = Materials()) -> DataFrame:
    """(id, pool, answer, n) of all materials but the bands."""

    def lines(name: str, schema: str, optional: bool = False) -> DataFrame:
        return readers.read_pools(spark, [f"{folder.rstrip('/')}/{name}"], f"id string, {schema}", optional)

    def dealt(rows: DataFrame, pools: list[str], answer: Column, n: Column | None = None) -> DataFrame:
        """Rows of a file for each pool that it counts in; a file is read once, whatever its roles."""
        made = _one(rows, pools[0], answer, n)
        return made if len(pools) == 1 else made.withColumn("pool", F.explode(F.array(*map(F.lit, pools))))

    said = T.canonical(F.coalesce("prediction", T.extract_final_first(F.col("response"))))
    each = T.canonical(F.col("one"))
    parts = []
    for k, name in enumerate(names.voters):
        parts.append(dealt(lines(name, "prediction string, response string"), ["voters", "own"] if not k else ["voters"], said))
    texts = lines(names.samples, "responses array<string>").select("id", F.explode("responses").alias("one"))
    parts.append(_one(texts, "samples", T.canonical(T.extract_final_first(F.col("one")))))
    roles: dict[str, list[str]] = {}
    for pool, files in (("low", names.low_pools), ("middle", names.middle_pools), ("guard", names.guard_pools or names.low_pools + names.middle_pools)):
        for name in files:
            roles.setdefault(name, []).append(pool)
    for name, pools in roles.items():
        verified = lines(name, "verified_counts map<string,bigint>", True).select("id", F.explode("verified_counts").alias("one", "n"))
        parts.append(dealt(verified, pools, T.canonical_output(F.col("one")), F.col("n")))
    lists: dict[str, list[str]] = {}
    for pool, files in (("mode", (names.screened,)), ("pool", names.pointer_pools), ("repeats", (names.repeats,))):
        for name in files:
            lists.setdefault(name, []).append(pool)
    for name, pools in lists.items():
        predicted = lines(name, "predictions array<string>").select("id", F.explode("predictions").alias("one"))
        parts.append(dealt(predicted, pools, each))
    parts.append(_one(lines(names.pointer, "prediction string"), "pointer", T.canonical(F.col("prediction"))))
    return reduce(DataFrame.unionByName, parts)


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """(id, support, votes, nrisky) of one JSON object of maps, of any size."""
    found = jsondoc.elements(spark, path, 2, stored)
    # ids without escapes and their whole numbers need no parser
    plain = F.col("text").rlike(PLAIN_ENTRY)
    cut = F.split("text", '"\\s*:\\s*', 2)
    short = found.filter(plain).select(F.col("path")[0].alias("kind"), F.substring(cut[0], 2, 1 << 30).alias("id"), cut[1].cast("bigint").alias("n"))
    other = found.filter(~plain).select(F.col("path")[0].alias("kind"), F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,bigint>")).alias("id", "n"))
    return short.unionByName(other).groupBy("id").agg(*[F.max(F.when(F.col("kind") == m, F.col("n"))).alias(m) for m in BANDS])


def compose(spark: SparkSession, problems: DataFrame, folder: str, names: Materials = Materials(), rules: Rules = Rules()) -> DataFrame:
    """(ord, id, gold, base, c1 .. c4) of problems (ord, id, answer)."""
    bands = stored(read_bands(spark, f"{folder.rstrip('/')}/{names.bands}"))
    ids = problems.select("ord", F.col("id").cast("string").alias("id"), T.canonical(F.col("answer")).alias("gold"))
    checks.require_empty(checks.unknown_ids(ids, bands.filter("support is not null and votes is not null and nrisky is not null")), "problems without bands")
    per, c = V.pooled_tops(counts(spark, folder, names), ("voters", "own", "samples", "low", "middle", "mode", "pointer"), ("guard", "pool", "repeats")), F.col
    wide = ids.join(bands, "id").join(per, "id", "left")
    clear = F.coalesce(~c("voters.ties") & (c("voters.support") >= 2), F.lit(False))
    wide = wide.select(
        "ord", "id", "gold", "support", "votes", "nrisky", F.when(clear, c("voters.top")).otherwise(c("own.top")).alias("base"),
        V.single_top(c("samples"), rules.sample_votes).alias("sample_pick"), V.single_top(c("low"), rules.tool_votes).alias("low_pick"),
        V.single_top(c("middle"), rules.tool_votes).alias("middle_pick"), V.single_top(c("mode"), rules.mode_votes).alias("mode"),
        c("guard").alias("code_counts"), c("pointer.top").alias("pointer"), "pool", "repeats",
    )
    return gates.chain(wide, rules.chain).select("ord", "id", "gold", *STAGES)


def run(spark: SparkSession, problems: DataFrame, folder: str, emit: dict[str, str] | None = None, names: Materials = Materials(), rules: Rules = Rules(), one_file: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """Scores of the stages, each against the one before, and the number of missing answers of each stage emitted.
    emit: stage to path of its submission, which many tasks write without one_file. The chain runs once."""
    rows = round_store(compose(spark, problems, folder, names, rules), scratch_folder(spark), "composed")
    checks.require_parameters(**{f"stage_{s}": s in STAGES for s in emit or {}})
    missing = sinks.write_stages(rows, emit or {}, one_file=one_file)
    return metrics.stage_delta(rows, list(STAGES)), missing
