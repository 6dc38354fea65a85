"""Screening of problems by how often a model's samples are right, and the training pool of a band of that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.operators import curation, metrics, rollouts
from quillsieve.operators.chat import prompt_messages
from quillsieve.plans.scratch import stored


def screen(questions: DataFrame, provider: rollouts.Provider, samples: int = 8, max_tokens: int = 1024, seed: int = 0, workers: int = 8, rate: float | None = None, responses: bool = False) -> DataFrame:
    """(id, answer, num_samples, n_correct, pass_rate, truncated, predictions[, responses]) of questions (id, question, answer).
    Rows whose request failed are left out, so that a resumed run asks them again; a missing gold answer is matched by nothing."""
    none = F.array().cast("array<struct<user:string,assistant:string>>")
    asked = questions.select("id", prompt_messages(F.lit(T.PROMPTS["default"]), none, F.col("question")).alias("messages"))
    got = stored(rollouts.generate(asked, provider, samples, max_tokens, seed, workers, rate=rate)).filter("error is null")  # asked once
    gold = questions.select("id", T.canonical(F.regexp_replace("answer", ",", "")).alias("gold"))
    said = got.select("id", "sample_index", "response", "truncated", T.canonical(T.extract_final_first(F.col("response"))).alias("answer"))
    rates = metrics.pass_rate(said, gold)
    lists = said.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sample_index", "answer", "response"))).alias("s"))  # as many as samples
    out = rates.join(lists, "id").join(gold, "id", "left")
    columns = ["id", F.col("gold").alias("answer"), "num_samples", "n_correct", "pass_rate", "truncated", F.transform("s", lambda x: x["answer"]).alias("predictions")]
    return out.select(*columns, *([F.transform("s", lambda x: x["response"]).alias("responses")] if responses else []))


def training_pool(screened: DataFrame, pool: DataFrame, training: DataFrame, low: int, high: int) -> tuple[DataFrame, dict]:
    """Rows (id, prompt, answer, screen_n_correct) of pool (id, question, answer) whose screen has low..high right samples, but
    for those of the training set, and the manifest's counts. A screened row that the pool lacks is an error."""
    fit = curation.band_pool(pool, screened, training, low, high, strict=True)
    none = F.array().cast("array<struct<user:string,assistant:string>>")
    answer = F.regexp_replace(T.strip(F.coalesce(F.col("answer").cast("string"), F.lit(""))), ",", "")
    rows = stored(fit.select("id", prompt_messages(F.lit(T.PROMPTS["default"]), none, F.col("question")).alias("prompt"), answer.alias("answer"), F.col("n_correct").alias("screen_n_correct")))
    histogram = {str(r["n_correct"]): r["count"] for r in screened.groupBy("n_correct").count().orderBy("n_correct").collect()}  # as many as samples
    inside = screened.filter(F.col("n_correct").between(low, high))
    counts = {"screened": screened.count(), "samples": rows.count(), "band": f"n_correct {low}..{high}", "band_histogram": histogram, "training_skipped": inside.join(training.select("id"), "id", "left_semi").count()}
    return rows, counts
