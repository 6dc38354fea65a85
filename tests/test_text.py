"""Scalar functions: hand-made cases for each trap."""

import re

import pytest
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.functions import udfs


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_extract(spark):
    texts = [r"\boxed{12} then \boxed{ -1,234 }", r"Final answer: \(-7\) and 9", "정답: 42 of 100", "no digits", "", None, "a 1 b 2,", r"\boxed{3} Final answer: 5"]
    assert apply(spark, T.extract_boxed_first, texts) == ["-1234", "9", "42", None, None, None, "2", "3"]
    assert apply(spark, T.extract_final_first, texts) == ["-1234", "-7", "42", None, None, None, "2", "5"]
    assert apply(spark, T.extract_reward, ["Final answer \\boxed{+5}", "최종 정답: 6", r"\boxed{7} answer 8", "answer is 9 of 10", "x 11"]) == ["+5", "6", "7", "9", "11"]


def test_integers(spark):
    values = ["007", "-0", "+5", "3.0", "3.7", "-3.7", "1e3", "1,000", " 12 ", "\n5\t", "inf", "nan", "none", "9" * 25, "3d", "1_000", "", None, "1e25", ".5", "--1"]
    assert apply(spark, T.canonical, values) == ["7", "0", "5", "3", "3", "-3", "1000", "1000", "12", "5", None, None, None, "9" * 25, None, "1000", None, None, None, "0", None]
    assert apply(spark, T.canonical_output, ["1,000", "7.0", " 8 "]) == [None, "7", "8"]
    assert apply(spark, T.strict_integer, ["007", "-0", "+5", "3.0", "1,000", " 12\n"]) == ["7", "0", None, None, "1000", "12"]
    assert apply(spark, T.curated_integer, ["−5", "1,200", r"90^\circ", "45°", r"12\%", r"7\text{ cm}", "8.000", "8.5", "+3", None]) == ["-5", "1200", "90", "45", "12", "7", "8", None, "3", None]


def test_hash_answer(spark):
    got = apply(spark, T.hash_answer, ["a <<1+1=2>>2\n#### 1,002", "no mark", "x\n#### several", "two\n#### 5 \n"])
    assert [None if g is None else tuple(g) for g in got] == [("a 2", "1002"), None, None, ("two", "5")]


def test_tokens_and_shingles(spark):
    assert apply(spark, T.normalized, ["Ab-12 cD!", "", None, "é1"]) == ["ab 12 cd", "", None, "1"]
    assert apply(spark, lambda c: T.shingles(T.tokens(c)), ["a b c d e f", "a b", "", "a a a a a a a"]) == [["a b c d e", "b c d e f"], ["a b"], [], ["a a a a a"]]


def test_jaccard_and_ratio(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    got = df.select(T.jaccard(F.col("x"), F.col("y")).alias("j"), T.length_ratio(F.col("x"), F.col("y")).alias("r")).collect()
    assert [(round(g["j"], 6), g["r"]) for g in got] == [(0.333333, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_hashes(spark):
    import hashlib

    assert apply(spark, lambda c: T.stable_score(2026, "ns", c), ["q"]) == [hashlib.sha256(b"2026:ns:q").hexdigest()]
    assert apply(spark, T.unit_interval, ["17"]) == [int(hashlib.sha256(b"17").hexdigest()[:8], 16) / 2**32]


def test_risky(spark):
    texts = [None, "", "Final answer: 12", "Final answer: 12\nand more text", r"\boxed{5} later", "the answer 12", "final answer $\\(7\\)$.", "Final answer: 12" + " pad" * 120]
    assert apply(spark, T.risky, texts) == [True, True, False, False, False, True, False, True]
    assert apply(spark, T.risky_loose, ["final answer is 3x", "정답: 5", r"\boxed{-2", None]) == [False, True, False, True]


def test_code_and_flags(spark):
    assert apply(spark, T.code_block, ["```python\na\n```\n```\nb\n```", "```py\nc```", "none"]) == ["b\n", "c", None]
    assert apply(spark, T.is_true, ["Yes", " true ", "VALID", "1", "no", None, ""]) == [True, True, True, True, False, False, False]


def test_visual(spark):
    assert apply(spark, lambda c: c.rlike(T.VISUAL), ["see http://x", "a.PNG file", "figure  below", "shown above", "a jpg", "diagrams above"]) == [True, True, True, True, False, False]


def test_training_messages(spark):
    df = spark.createDataFrame([(" Q? ", " body\n\nFinal answer: 3 ", "4")], "q string, s string, a string")
    m = df.select(T.training_messages(F.col("q"), F.col("s"), F.col("a")).alias("m")).first()["m"]
    assert [x["role"] for x in m] == ["system", "user", "assistant"] and m[1]["content"] == "Q?" and m[2]["content"] == "body\n\nFinal answer: 4"


def test_feedback(spark):
    df = spark.createDataFrame([("ok", " 5 \n", ""), ("ok", "", ""), ("error", "x", "E" * 500), ("timeout", "", "")], "s string, o string, e string")
    got = [r["f"] for r in df.select(T.feedback(F.col("s"), F.col("o"), F.col("e"), "Go.").alias("f")).collect()]
    assert got[0] == "Program output:\n```\n5\n```\nGo." and "(no output)" in got[1] and got[2] == "Program output:\n```\nx\n[error] " + "E" * 400 + "\n```\nGo."
    asked = [r["f"] for r in df.select(T.repair_request(F.col("s"), F.col("e"), "Fix.").alias("f")).collect()]
    assert asked[3] == "Program output:\n```\n[timeout] timeout\n```\nFix."


def plain_confidence(x, win, stride):
    if not x:
        return None, None, None
    mean = lambda s: sum(s) / len(s)
    return mean(x), mean(x[-win:]), min(mean(x[s : s + win]) for s in range(0, max(1, len(x) - win + 1), stride))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 11, 12])
def test_confidence(spark, n):
    x = [float((7 * k) % 5 - k) for k in range(n)]
    got = apply(spark, lambda c: T.confidence(c, 4, 2), [x], "array<double>")[0]
    assert all(a is b is None or abs(a - b) < 1e-12 for a, b in zip(got[:3], plain_confidence(x, 4, 2))) and got["ntok"] == n


def test_boxed(spark):
    texts = [r"\boxed{\frac{1}{2}} x \boxed {3}", r"\boxed{a \boxed{b}}", r"\boxed{open", None, ""]
    assert apply(spark, udfs.boxed_values, texts) == [[r"\frac{1}{2}", "3"], [r"a \boxed{b}", "b"], [], [], []]
    assert apply(spark, udfs.boxed_answer, [r"\boxed{1} \boxed{12\%}", "none"]) == ["12", None]


def test_sequence_ratio(spark):
    from difflib import SequenceMatcher

    rows = [("the quick fox", "the quack fox"), ("", ""), ("abc", "xyz"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r["r"] for r in df.select(udfs.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in rows]
    assert [r["r"] for r in df.select(udfs.sequence_at_least(0.9)(F.col("a"), F.col("b")).alias("r")).collect()] == [g >= 0.9 for g in got]


def test_counters(spark):
    assert apply(spark, udfs.count_words, ["a b  c", "", None]) == [3, 0, 0]
    assert apply(spark, udfs.token_counter(lambda t: len(re.findall(".", t))), ["abc", None]) == [3, 0]


def test_prompts_and_completions(spark):
    assert apply(spark, T.prompt, ["concise", "unknown"])[1] is None
    df = spark.createDataFrame([([("user", "a"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    assert df.select(T.flatten_completion(F.col("m")).alias("t")).first()["t"] == "a\n"


def test_casefold_of_all_characters(spark):
    """Python's casefold over every code point, in runs of 500; tokens over the basic plane."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    runs = [" x".join(map(chr, points[k : k + 500])) for k in range(0, len(points), 500)] + ["", "Straße ﬁn", "PLAIN ascii"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(runs)], "k int, t string").repartition(3)
    assert {r["k"]: r["f"] for r in df.select("k", T.casefold(F.col("t")).alias("f")).collect()} == {k: t.casefold() for k, t in enumerate(runs)}
    found = {r["k"]: r["w"] for r in df.select("k", T.tokens(F.col("t")).alias("w")).collect()}
    basic = [k for k, t in enumerate(runs) if max(t, default="") < "\U00010000"]
    assert len(basic) > 100 and all(found[k] == re.findall(r"[a-z]+|\d+", runs[k].casefold()) for k in basic)
