"""python -m quillsieve evaluate|submission|compose|rebuild|merge|curate|screen|pool|rollout: ensembles of prediction or submission
files, the chain of gates over a folder of materials, its first stages from raw texts, training files put together, rows
curated from corpora, problems screened by a model server, a training pool of a band, and verified tool answers."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text, udfs
from quillsieve.operators import chat, checks, curation, metrics, rollouts, votes
from quillsieve.operators.rollouts import round_store
from quillsieve.plans import compose as composing
from quillsieve.plans import curate as curating
from quillsieve.plans import rebuild as rebuilding
from quillsieve.plans import screen as screening
from quillsieve.plans.scratch import scratch_folder, stored
from quillsieve.session import session
from quillsieve.sources import readers, sinks

PREDICTIONS = "id string, answer string, prediction string, response_tokens int, retried_truncated boolean"


def same_ids(voters: list[DataFrame]) -> None:
    for other in voters[1:]:
        checks.require_empty(checks.id_differences(voters[0], other), "id sets differ")
        if not checks.same_order(voters[0], other):
            print("warning: the order of rows differs; that of the first input is used", file=sys.stderr)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with their place in the input."""
    return rows.withColumn("ord", F.monotonically_increasing_id())


def evaluate(args) -> None:
    spark = session(args.master)
    voters = [readers.read_predictions(spark, p, PREDICTIONS, stored, integers=("prediction", "answer"), ord_col="ord") for p in args.inputs]
    checks.require_parameters(fallback_voter=1 <= args.fallback_voter <= len(voters))
    same_ids(voters)
    long = reduce(DataFrame.unionByName, [v.withColumn("idx", F.lit(i)) for i, v in enumerate(voters)])
    checks.require_empty(checks.gold_conflicts(long), "voters disagree on the gold answer")
    stuck = F.coalesce(F.col("retried_truncated") & (F.col("response_tokens") >= args.stuck_threshold), F.lit(False)) if args.abstain_truncated else F.lit(False)
    raw = long.select("id", "idx", F.col("prediction").alias("answer"), stuck.alias("abstained"))
    used = raw.withColumn("answer", F.when(~F.col("abstained"), F.col("answer")))
    chosen = votes.choose(used, args.fallback_voter - 1, args.abstain_truncated)
    # one row an id, as many votes as inputs
    each = raw.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "answer", "abstained"))).alias("v"))
    each = each.select(
        "id",
        F.transform("v", lambda x: F.when(~x["abstained"], x["answer"])).alias("votes"),
        F.transform("v", lambda x: x["answer"]).alias("raw_votes"),
        F.transform(F.filter("v", lambda x: x["abstained"]), lambda x: x["idx"] + 1).alias("abstained_voters"),
    )
    gold = voters[0].select("id", F.col("answer").alias("gold"), "ord")
    out = chosen.withColumnRenamed("answer", "prediction").join(gold, "id").join(each, "id")
    out = out.withColumn("correct", F.col("prediction").eqNullSafe(F.col("gold"))).withColumn("fallback_voter", F.lit(args.fallback_voter))
    named = out.select("ord", "id", F.col("gold").alias("answer"), "prediction", "correct", "votes", "raw_votes", "abstained_voters", "decision", "fallback_voter")
    sinks.write_jsonl(named.orderBy("ord").drop("ord"), args.output)
    metrics.accuracy(out, "prediction", "gold").show()
    metrics.voter_accuracy(raw, gold.drop("ord")).orderBy("idx").show()
    metrics.decision_counters(chosen, raw, args.fallback_voter - 1, F.col("abstained")).show()


def submission(args) -> None:
    spark = session(args.master)
    voters = [in_order(readers.read_submission(spark, p)) for p in args.inputs]
    checks.require_parameters(fallback_voter=1 <= args.fallback_voter <= len(voters))
    same_ids(voters)
    if args.expected_rows:
        checks.require_count(voters[0], args.expected_rows)
    long = reduce(DataFrame.unionByName, [v.withColumn("idx", F.lit(i)) for i, v in enumerate(voters)])
    chosen = votes.choose(long, args.fallback_voter - 1)
    sinks.write_submission(voters[0].select("id", "ord").join(chosen, "id"), args.output)


def compose(args) -> None:
    """Scores of the stages, and the submissions of those to emit."""
    spark = session(args.master)
    problems = in_order(readers.read_csv(spark, args.input))
    if "answer" not in problems.columns:
        problems = problems.withColumn("answer", F.lit(None).cast("string"))
    names = composing.Materials(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(args.names or "{}").items()})
    emit = dict(e.split("=", 1) for e in args.emit)
    scores, missing = composing.run(spark, problems, args.materials, emit, names)
    scores.show()
    for stage, n in missing.items():
        print(f"{stage}: {emit[stage]}, {n} missing answers")


def rebuild(args) -> None:
    """The first stages from raw texts; how many answers of each differ from a golden submission; submissions of the stages."""
    spark = session(args.master)
    problems = in_order(readers.read_csv(spark, args.input))
    names = rebuilding.Files(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(args.names or "{}").items()})
    bands = tuple(b for b in args.risky_bands.split(",") if b)
    rows = round_store(rebuilding.rebuild(spark, problems, args.materials, args.extractor, bands, names), scratch_folder(spark), "rebuilt")
    metrics.frequencies(rows, "support").orderBy("support").show()
    for stage, differ in rebuilding.verify(spark, rows, dict(g.split("=", 1) for g in args.golden)).items():
        n, shown = differ.count(), [r["id"] for r in differ.orderBy("id").limit(10).collect()]  # a few examples
        print(f"{stage}: {n} answers differ {shown if n else ''}".rstrip())
    sinks.write_stages(rows, dict(e.split("=", 1) for e in args.emit))


def merge(args) -> None:
    """Training rows of all inputs by id, each teacher's as often as asked for."""
    spark = session(args.master)
    asked = [r.rpartition("=") for r in args.teacher_repeat]
    checks.require_parameters(teacher_repeat=all(t and n.isdigit() and int(n) >= 1 for t, _, n in asked))
    parts = [spark.read.json(p) for p in args.inputs]
    repeats = spark.createDataFrame([(t, int(n)) for t, _, n in asked], "teacher string, repeats int")
    for part in parts:
        checks.require_empty(checks.bad_chats(part).select("id"), "messages that aren't a system, a user and an assistant turn")
    rows = curation.merge(parts, "teacher", repeats, udfs.count_words(chat.render(F.col("messages"))), args.max_length)
    sinks.write_jsonl(rows.orderBy("id", "training_repeat"), args.output)


def curate(args) -> None:
    """Rows chosen from the corpora of a plan (JSON: sources with name, path, quotas, quota_key and optional silent and reasons
    as SQL conditions), in order, none near an official question."""
    spark = session(args.master)
    plan = json.loads(args.plan)
    sources = []
    for s in plan["sources"]:
        rows = in_order(spark.read.json(s["path"]))
        reasons = tuple((reason, F.expr(condition)) for reason, condition in s.get("reasons", []))
        sources.append(curating.Source(s["name"], rows, s["quotas"], s["quota_key"], reasons, F.expr(s["silent"]) if "silent" in s else None))
    official = readers.read_csv(spark, args.official).select(F.col("question").alias("text"))
    judged = curating.judge(sources, official, limits=curating.Limits(args.min_tokens, args.max_tokens))
    chosen = stored(curating.choose(judged, sources, args.seed))
    sinks.write_jsonl(chosen.orderBy("source", "place").select("source", "id", "question", "solution", "stratum", "n_tokens"), args.output)
    sinks.write_manifest(chosen, args.output + ".manifest", args.output, **curating.counted(judged, chosen, args.seed))


def _asked(args) -> tuple:
    """Questions that the output lacks yet, and the server."""
    spark = session(args.master)
    questions = readers.read_rows(spark, args.input, "id string, question string, answer string")
    if "answer" not in questions.columns:
        questions = questions.withColumn("answer", F.lit(None).cast("string"))
    if args.resume and readers.exists(spark, args.output):
        questions = questions.join(readers.read_jsonl(spark, args.output, "id string").select("id"), "id", "left_anti")
    provider = rollouts.HttpProvider(args.base_url, args.model, args.temperature, args.top_p)
    return spark, questions, provider


def screen(args) -> None:
    _, questions, provider = _asked(args)
    sinks.append_rows(screening.screen(questions, provider, args.num_samples, args.max_new_tokens, args.seed, args.request_workers, args.rate, args.save_responses), args.output)


def rollout(args) -> None:
    """Samples with programs that are run, repaired and concluded; the verified answers of each problem."""
    spark, questions, provider = _asked(args)
    config = rollouts.RolloutConfig(samples=args.num_samples, no_code_rounds=args.no_code_rounds, repair_rounds=args.repair_rounds, seed=args.seed)
    samples = stored(rollouts.trajectories(questions, provider, scratch_folder(spark), config))
    sinks.append_rows(rollouts.tool_pool(samples), args.output)
    if args.samples_output:
        sinks.append_rows(samples, args.samples_output)


def pool(args) -> None:
    spark = session(args.master)
    screened = readers.read_jsonl(spark, args.screen, "id string, n_correct int")
    training = readers.read_jsonl(spark, args.training, "id string").withColumn("id", text.strip(F.col("id")))
    rows, counts = screening.training_pool(screened, readers.read_csv(spark, args.pool_csv).withColumn("id", text.strip(F.col("id"))), training, args.min_correct, args.max_correct)
    sinks.write_jsonl(rows.orderBy("id"), args.output)
    sinks.write_manifest(rows, args.output + ".manifest", args.output, **counts)
    print(json.dumps(counts))


def main() -> None:
    parser = argparse.ArgumentParser(prog="quillsieve")
    parser.add_argument("--master", default="local[*]")
    kinds = parser.add_subparsers(required=True)
    for name, run in (("evaluate", evaluate), ("submission", submission)):
        p = kinds.add_parser(name)
        p.add_argument("inputs", nargs="+")
        p.add_argument("--output", required=True)
        p.add_argument("--fallback-voter", type=int, default=1)
        p.set_defaults(run=run)
        if name == "evaluate":
            p.add_argument("--abstain-truncated", action="store_true")
            p.add_argument("--stuck-threshold", type=int, default=2046)
        else:
            p.add_argument("--expected-rows", type=int)
    p = kinds.add_parser("compose")
    p.add_argument("--input", required=True)
    p.add_argument("--materials", required=True)
    p.add_argument("--emit", action="append", default=[], help="stage=path, any number of times")
    p.add_argument("--names", help="JSON object of file names by role")
    p.set_defaults(run=compose)
    p = kinds.add_parser("rebuild")
    p.add_argument("--input", required=True)
    p.add_argument("--materials", required=True)
    p.add_argument("--extractor", choices=sorted(rebuilding.EXTRACTORS), default="boxed_first")
    p.add_argument("--risky-bands", default="", help="low, middle, or both with a comma")
    p.add_argument("--golden", action="append", default=[], help="stage=path, any number of times")
    p.add_argument("--emit", action="append", default=[], help="stage=path, any number of times")
    p.add_argument("--names", help="JSON object of file names by role")
    p.set_defaults(run=rebuild)
    p = kinds.add_parser("merge")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--teacher-repeat", action="append", default=[], help="teacher=count, any number of times")
    p.add_argument("--max-length", type=int)
    p.set_defaults(run=merge)
    p = kinds.add_parser("curate")
    p.add_argument("--plan", required=True, help="JSON object of sources")
    p.add_argument("--official", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--min-tokens", type=int, default=64)
    p.add_argument("--max-tokens", type=int, default=900)
    p.set_defaults(run=curate)
    for name, run in (("screen", screen), ("rollout", rollout)):
        p = kinds.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--model", required=True)
        p.add_argument("--base-url", default="http://localhost:8000/v1")
        p.add_argument("--num-samples", type=int, default=8)
        p.add_argument("--temperature", type=float, default=0.7)
        p.add_argument("--top-p", type=float, default=0.95)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--resume", action="store_true")
        p.set_defaults(run=run)
        if name == "screen":
            p.add_argument("--max-new-tokens", type=int, default=1024)
            p.add_argument("--request-workers", type=int, default=8, help="a task")
            p.add_argument("--rate", type=float, help="requests a second of the whole job")
            p.add_argument("--save-responses", action="store_true")
        else:
            p.add_argument("--no-code-rounds", type=int, default=0)
            p.add_argument("--repair-rounds", type=int, default=1)
            p.add_argument("--samples-output")
    p = kinds.add_parser("pool")
    p.add_argument("--screen", required=True)
    p.add_argument("--pool-csv", required=True)
    p.add_argument("--training", required=True)
    p.add_argument("--min-correct", type=int, default=2)
    p.add_argument("--max-correct", type=int, default=6)
    p.add_argument("--output", required=True)
    p.set_defaults(run=pool)
    args = parser.parse_args()
    args.run(args)


if __name__ == "__main__":
    main()
