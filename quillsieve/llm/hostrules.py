"""Quality rules with host-level verdicts, in DataFrame functions only.

Each text is measured by the rules below. Failures are summed by host (the `source` of a document; null
and the empty name are one host), each rule's rate is shrunk with a beta prior fitted to all hosts by the
method of moments, and a host whose shrunk rate passes `host_rate` for any rule is rejected as a whole.
A document stays if it passes the base rules itself and its host isn't rejected.

Windows of eight words are compared by 64-bit XXH64 values within one text. Measures are written once,
without the text unless it is asked for, since both the host sums and the documents need them.

Defined results: a null or empty text has no words and fails; a table of one host has a prior of strength
one; a host at the very rate stays; repeated rows count repeatedly; a null id is kept; a text of any length is measured as a
whole; an empty table gives an empty result; columns that have the name of a result are replaced, all others
are carried along inside one column, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import SPACES, written

#: Hosts up to which the rejected ones are broadcast; beyond it they are joined by shuffle.
BROADCAST_HOSTS = 100_000
LONG = "long"


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _after(column: str, k: int = 1) -> Column:
    """The array from its k-th element on, counted from 0."""
    return F.slice(column, F.lit(k + 1), F.greatest(F.size(column) - k, F.lit(0)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of the rules; columns of those names in docs are replaced."""
    carried = [F.col(c) for c in docs.columns if c not in (*MEASURES, "kept")]
    return _measured(docs, F.struct(*carried), text_col).select("row.*", *MEASURES)


def _measured(docs: DataFrame, row: Column, text_col: str, **more: Column) -> DataFrame:
    """(row, more..., _qr_n_lines, the measures). Arrays that are read more than once are columns of their own, so that
    each is computed once a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = ["row", *more]
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    n = F.size("_qr_words")
    step = docs.select(row.alias("row"), *[c.alias(name) for name, c in more.items()], text.alias("_qr_text"), words_of(text).alias("_qr_words"), lines.alias("_qr_lines"))
    step = step.select(
        *kept,
        n.alias("_qr_n"),
        F.length(F.array_join("_qr_words", "")).cast(LONG).alias("word_chars"),
        F.regexp_count("_qr_text", F.lit("[#*$%&|<>]")).cast(LONG).alias("n_symbols"),
        F.size("_qr_lines").cast(LONG).alias("_qr_n_lines"),
        (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast(LONG).alias("n_dup_lines"),
        F.transform("_qr_words", lambda w: F.xxhash64(w)).alias("_qr_h"),
    )
    # hashes of 2, 4 and 8 words from those of 1, 2 and 4; the last ones run over the end and are cut off
    for k in (1, 2, 4):
        step = step.withColumn("_qr_h", F.zip_with("_qr_h", _after("_qr_h", k), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_qr_h", F.slice("_qr_h", F.lit(1), F.greatest(F.col("_qr_n") - 7, F.lit(0))))
    some = F.size(F.array_distinct("_qr_h")) < F.size("_qr_h")
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    # (hash, place) in order of hash; equal neighbours mark their places; each place covers up to the next one
    step = step.withColumn("_qr_h", F.when(some, F.sort_array(F.transform("_qr_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(nothing))
    step = step.withColumn("_qr_same", F.zip_with("_qr_h", _after("_qr_h"), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    before = F.concat(F.array(F.lit(False)), F.slice("_qr_same", F.lit(1), F.greatest(F.size("_qr_same") - 1, F.lit(0))))
    step = step.withColumn("_qr_same", F.when(F.size("_qr_same") > 0, F.zip_with("_qr_same", before, lambda a, b: a | b)))
    places = F.filter(F.zip_with("_qr_h", "_qr_same", lambda s, e: F.when(e, s["i"])), lambda i: i.isNotNull())
    step = step.withColumn("_qr_places", F.sort_array(F.coalesce(places, F.array().cast("array<int>"))))
    covered = F.zip_with("_qr_places", _after("_qr_places"), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
    step = step.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda total, x: total + x).cast(LONG))
    step = step.withColumn("n_words", F.col("_qr_n").cast(LONG)).drop("_qr_h", "_qr_same", "_qr_places", "_qr_n")
    return step.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


#: Failures that are summed by host.
RULES = {
    "short": "n_words < 20",
    "repetitive": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "100 * n_dup_lines > 50 * _qr_n_lines",
    "word_length": "word_chars > 25 * n_words",
}


def host_verdicts(measured: DataFrame, host: Column, host_rate: float) -> DataFrame:
    """(host, n, one shrunk rate a rule, rejected)."""
    sums = measured.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"cast({rule} as long)")).alias(name) for name, rule in RULES.items()])
    sums = written(sums, "hosts")
    moments = sums.agg(*[f(F.col(name) / F.col("n")).alias(f"{name}_{k}") for name in RULES for k, f in (("mean", F.avg), ("var", F.var_pop))]).first()  # one row
    rates = []
    for name in RULES:
        mean, var = moments[f"{name}_mean"] or 0.0, moments[f"{name}_var"] or 0.0
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e4) if var > 0 else 1.0
        rates.append(((F.col(name) + mean * strength) / (F.col("n") + strength)).alias(name))
    shrunk = sums.select("host", "n", *rates)
    return shrunk.withColumn("rejected", F.greatest(*[F.col(name) for name in RULES]) > host_rate)


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_rate: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default), the measures, base_failed and kept."""
    carried = [F.col(c) for c in (docs.columns if keep is None else keep) if c not in (*MEASURES, "kept")]
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    measured = _measured(docs, F.struct(*carried) if carried else F.struct(F.lit(0)), text_col, host=host)
    measured = written(measured.select("row", "host", "_qr_n_lines", *MEASURES), "measures")
    bad = written(host_verdicts(measured, F.col("host"), host_rate).filter("rejected").select("host", F.lit(True).alias("bad")), "rejected-hosts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = measured.join(bad, "host", "left")
    return joined.select(*(["row.*"] if carried else []), *MEASURES, (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"))


def digests(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
