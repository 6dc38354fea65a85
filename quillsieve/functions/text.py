"""Scalar functions on text columns, all of them expressions that Catalyst compiles.

Regular expressions are Java's: \\d and \\s are ASCII.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence
from functools import cache
from string import ascii_uppercase as UPPER

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, prompts and formats that results depend on.
FENCED = r"(?s)```(?:python|py)?\s*\n(.*?)```"
BOXED_FIRST = (r"\\boxed\s*\{\s*(-?\d[\d,]*)\s*\}", r"(?i)(?:final answer|answer|정답)\s*(?:is|:|=)?\s*(-?\d[\d,]*)", r"(-?\d[\d,]*)")
FINAL_FIRST = (r"(?i)(?:final answer|정답)\s*(?:is|:|=)?\s*[^\d\-]{0,15}?(-?\d[\d,]*)", r"\\boxed\s*\{\s*(-?\d[\d,]*)\s*\}", r"(-?\d[\d,]*)")
REWARD = (
    r"(?i)(?:final\s+answer|최종\s*정답)\s*(?:is|:|=)?\s*(?:\\boxed\s*\{\s*)?([+-]?\d[\d,]*)",
    r"\\boxed\s*\{\s*([+-]?\d[\d,]*)\s*\}",
    r"(?i)(?:answer|정답)\s*(?:is|:|=)?\s*([+-]?\d[\d,]*)",
    r"([+-]?\d[\d,]*)",
)
STRICT_TAIL = (r"(?im)(?:final answer|정답)\s*(?:is|:|=)?\s*\$?\\?\(?\s*(-?\d[\d,]*)\s*\\?\)?\$?\s*\.?\s*$", r"\\boxed\s*\{\s*(-?\d[\d,]*)\s*\}")
LOOSE_TAIL = (r"(?i)(?:final answer\s*(?:is|:|=)?\s*\$?\\?\(?\s*-?\d|\\boxed\s*\{\s*-?\d)",)
VISUAL = r"(?i)https?://|www\.|\\includegraphics|\.(?:png|jpe?g|gif)\b|\b(?:diagram|figure)\s+(?:above|below)|\bshown\s+(?:above|below)\b"
TOKENS = r"[a-z]+|\p{Nd}+"
PLAIN = r"^(?:0|-?[1-9][0-9]*)\z"
TRUE_WORDS = ("yes", "true", "valid", "1")
MINUS_SIGNS, TEXT_MACRO = "−–", r"\\(?:text|mathrm|operatorname)\s*\{[^{}]*\}"
DEGREE_END, CURATED, ZERO_TAIL = r"(?:\^\s*\{?\\circ\}?|\\circ|°|\\%)$", r"^[+-]?\d+(?:\.0+)?$", r"\.0+$"
HASH_ANSWER, HASH_TAIL, CALCULATION = r"####\s*([^\n]+)\s*$", r"\s*####\s*[^\n]+\s*$", r"<<[^<>]*>>"
FINAL_LINE, FINAL_ANSWER = r"\n*Final answer:\s*[+-]?\d+\s*$", "\n\nFinal answer: "
OUTPUT_HEAD, OUTPUT_END, NO_OUTPUT, SHOWN_ERROR, TAIL_LENGTH = "Program output:\n```\n", "\n```\n", "(no output)", 400, 400
DERIVATION_PROMPT = (
    "Solve the math problem independently. Give a concise, logically complete derivation. Do not restate the problem or explore "
    "multiple approaches. The answer is always an integer. End with exactly: Final answer: <integer>"
)
PROMPTS = {
    "default": "Solve the math problem carefully. The answer is always an integer. End your response with exactly: Final answer: <integer>",
    "concise": (
        "Solve the math problem accurately and keep the reasoning concise. The answer is always an integer. Use at most 400 tokens. "
        "End your response with exactly: Final answer: <integer>"
    ),
    "verify": (
        "Solve the given math problem as a meticulous contest mathematician. First identify the exact quantity requested and all stated "
        "constraints. Work through the solution carefully. Before committing to the answer, independently verify it by substitution, "
        "enumeration, or a second method. Check signs, strict inequalities, integer ranges, ordered versus unordered counting, repeated "
        "cases, proper versus total divisors, overlapping regions, and whether a maximum or minimum was proved. Correct any failed check. "
        "Do not round unless explicitly required. The answer is always an integer. End your response with exactly: Final answer: <integer>"
    ),
    "program": (
        "You are a meticulous contest mathematician with a Python interpreter available.\n"
        "Solve the problem by writing Python code that computes the answer.\n"
        "Prefer brute-force enumeration, exhaustive case checking, and sympy over hand algebra — "
        "the interpreter is exact and fast, so verify rather than guess.\n"
        "Write exactly one Python code block in this format:\n```python\n# your code; it MUST print the result\nprint(result)\n```\n"
        "Then stop and wait. You will be shown the program output, and only then give the final answer.\n"
        "The answer is always an integer. End your final response with exactly: Final answer: <integer>"
    ),
    "symbolic": (
        "You are a meticulous contest mathematician with a Python interpreter and the sympy library.\n"
        "Solve the problem with EXACT symbolic computation using sympy: define unknowns with symbols(), "
        "set up equations with Eq(), and use solve(), simplify(), expand(), factor(), Rational(), "
        "summation(), or diff() as needed. Never use floating point — keep every step exact, and only "
        "convert the final exact result to an integer at the end. If symbolic solving stalls, fall back "
        "to exact enumeration.\n"
        "Write exactly one Python code block in this format:\n```python\nfrom sympy import *\n# your exact symbolic solution; it MUST print the result\nprint(result)\n```\n"
        "Then stop and wait. You will be shown the program output, and only then give the final answer.\n"
        "The answer is always an integer. End your final response with exactly: Final answer: <integer>"
    ),
    "rigor": (
        "Solve the math problem rigorously. Begin by listing the exact quantity requested and every condition that the final answer must "
        "satisfy. Maintain a checklist and explicitly verify that no condition is dropped. If the solution has multiple cases, branches, "
        "residue classes, configurations, or boundary cases, enumerate and finish all of them; never infer the general result from only "
        "some cases. After deriving a candidate integer answer, independently recompute or verify it by a genuinely separate method such "
        "as substitution, exhaustive enumeration, complementary counting, or checking all constraints. If verification reveals a "
        "contradiction or missed case, revise the reasoning and change the answer rather than reporting the original candidate. Do not "
        "guess when a derivation is incomplete. The answer is always an integer. End your response with exactly: Final answer: <integer>"
    ),
}


def strip(c: Column) -> Column:
    """All white space at both ends, not only blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def last_match(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def extract(c: Column, patterns: Sequence[str]) -> Column:
    """The last match of the first pattern that matches at all, without commas; null if none does."""
    return F.regexp_replace(F.coalesce(*[last_match(c, p) for p in patterns]), ",", "")


def extract_boxed_first(c: Column) -> Column:
    return extract(c, BOXED_FIRST)


def extract_final_first(c: Column) -> Column:
    return extract(c, FINAL_FIRST)


def extract_reward(c: Column) -> Column:
    return extract(c, REWARD)


def bare_integer(digits: Column) -> Column:
    """An optionally signed run of digits as a canonical integer string of any length."""
    short = F.regexp_replace(F.regexp_replace(digits, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(short == "-0", "0").otherwise(short)


def _loose_integer(s: Column) -> Column:
    plain = F.replace(s, F.lit("_"), F.lit(""))
    whole = s.rlike(r"^[+-]?\d+(_\d+)*$")
    real = s.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
    return F.when(whole, bare_integer(plain)).when(real, plain.try_cast("double").try_cast("bigint").cast("string"))


def _unless_plain(s: Column, made: Column) -> Column:
    """s itself where it is canonical already, which one look shows; most values are."""
    return F.when(s.rlike(PLAIN), s).otherwise(made)


def canonical(c: Column) -> Column:
    """Integer of a noisy value: blanks and commas go, reals are cut toward zero; else null. Reals beyond 64 bits are null."""
    s = c.cast("string")
    return _unless_plain(s, _loose_integer(strip(F.replace(s, F.lit(","), F.lit("")))))


def canonical_output(c: Column) -> Column:
    """As canonical(), for program output: commas are not dropped, so grouped digits are null."""
    s = c.cast("string")
    return _unless_plain(s, _loose_integer(strip(s)))


def strict_integer(c: Column) -> Column:
    """Digits with an optional minus, commas dropped; no plus, no fraction."""
    s = F.replace(strip(c.cast("string")), F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^-?\d+$"), bare_integer(s))


def curated_integer(c: Column) -> Column:
    """Integer of a typeset answer: unicode minus, text macros, degree and percent signs, .000 tails."""
    s = F.translate(F.replace(strip(c.cast("string")), F.lit(","), F.lit("")), MINUS_SIGNS, "--")
    s = F.regexp_replace(s, TEXT_MACRO, "")
    s = strip(F.regexp_replace(s, DEGREE_END, ""))
    return F.when(s.rlike(CURATED), bare_integer(F.regexp_replace(s, ZERO_TAIL, "")))


def hash_answer(c: Column) -> Column:
    """struct(solution, answer) of a text that ends in '#### answer', null if it doesn't or isn't an integer."""
    answer = curated_integer(F.nullif(F.regexp_extract(c, HASH_ANSWER, 1), F.lit("")))
    solution = F.regexp_replace(strip(F.regexp_replace(c, HASH_TAIL, "")), CALCULATION, "")
    return F.when(answer.isNotNull(), F.struct(solution.alias("solution"), answer.alias("answer")))


@cache
def folds() -> dict[str, str]:
    """Characters beyond ASCII that full case folding changes, by Python's own table."""
    every = (chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c}


def _replaced(c: Column, many: dict[str, str]) -> Column:
    """c with each character of `many` spelled out; texts without any are only looked through once."""
    out = c
    for old, new in many.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(c.rlike("[" + "".join(many) + "]"), out).otherwise(c)


def casefold(c: Column) -> Column:
    """Full case folding, one character to several where it says so. ASCII texts are lower-cased."""
    one = {k: v for k, v in folds().items() if len(v) == 1}
    many = {k: v for k, v in folds().items() if len(v) > 1}
    folded = F.translate(_replaced(c, many), UPPER + "".join(one), UPPER.lower() + "".join(one.values()))
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(c))


@cache
def letter_folds() -> dict[str, str]:
    """Characters whose folding has ASCII letters that lower-casing doesn't give: \u00df becomes ss. No others matter to tokens."""
    return {k: v for k, v in folds().items() if re.search("[a-z]", v) and re.findall("[a-z]", k.lower()) != re.findall("[a-z]", v)}


def tokens(c: Column) -> Column:
    """Runs of a-z and runs of digits of the folded text."""
    return F.regexp_extract_all(_replaced(F.lower(c), letter_folds()), F.lit(TOKENS), F.lit(0))


def tokens_sql(column: str) -> str:
    """The same in SQL, for the queries' oracles."""
    out = f"lower({column})"
    for old, new in letter_folds().items():
        out = f"replace({out}, '{old}', '{new}')"
    return rf"regexp_extract_all({out}, '[a-z]+|\p{{Nd}}+')"


def normalized(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def text_key(norm: Column) -> Column:
    """What normalised texts are joined and grouped by: their SHA-256, so that texts don't travel."""
    return F.sha2(norm, 256)


def shingles(words: Column, width: int = 5) -> Column:
    """Distinct runs of `width` words, joined; a shorter text is one shingle, an empty one has none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (width - 1))), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def length_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.least(F.size(a), F.size(b)) / longer)


def stable_score(seed: int, namespace: Column | str, text: Column) -> Column:
    name = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), name, text), 256)


def unit_interval(key: Column) -> Column:
    """0 to 1 from the first 8 hex digits of the SHA-256 of a key."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def risky(c: Column, patterns: Sequence[str] = STRICT_TAIL) -> Column:
    """No committed integer answer in the last 400 characters."""
    end = tail(c, TAIL_LENGTH)
    found = end.rlike(patterns[0])
    for p in patterns[1:]:
        found = found | end.rlike(p)
    return c.isNull() | (c == "") | ~found


def risky_loose(c: Column) -> Column:
    return risky(c, LOOSE_TAIL)


def code_block(c: Column) -> Column:
    """The last fenced code block, or null."""
    return last_match(c, FENCED)


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


def training_messages(question: Column, solution: Column, answer: Column, prompt: str = DERIVATION_PROMPT) -> Column:
    """System, user and assistant turn; the solution ends with one canonical final answer."""
    body = F.regexp_replace(F.regexp_replace(strip(solution), FINAL_LINE, ""), r"\s+$", "")
    return messages(("system", F.lit(prompt)), ("user", strip(question)), ("assistant", F.concat(body, F.lit(FINAL_ANSWER), answer)))


def flatten_completion(completion: Column, kind: str = "array") -> Column:
    """The text of a completion: of an array of turns the contents, one a line, of a single turn (`struct`) its
    content, of a `string` itself. A null content is empty."""
    if kind == "string":
        return F.coalesce(completion, F.lit(""))
    if kind == "struct":
        return F.coalesce(completion["content"], F.lit(""))
    return F.array_join(F.transform(completion, lambda t: F.coalesce(t["content"], F.lit(""))), "\n")


def prompt(style: Column) -> Column:
    """System prompt by style, null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])[style]


def feedback(status: Column, stdout: Column, stderr: Column, nudge: str) -> Column:
    """What the model is told about a program's run before its final answer."""
    body = F.coalesce(F.nullif(strip(stdout), F.lit("")), F.lit(NO_OUTPUT))
    failed = F.concat(body, F.lit("\n["), status, F.lit("] "), F.substring(strip(stderr), 1, SHOWN_ERROR))
    return F.concat(F.lit(OUTPUT_HEAD), F.when(status == "ok", body).otherwise(failed), F.lit(OUTPUT_END + nudge))


def repair_request(status: Column, stderr: Column, nudge: str) -> Column:
    reason = F.coalesce(F.nullif(F.substring(strip(stderr), 1, SHOWN_ERROR), F.lit("")), status)
    return F.concat(F.lit(OUTPUT_HEAD + "["), status, F.lit("] "), reason, F.lit(OUTPUT_END + nudge))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda total, x: total + x) / F.size(a)


def confidence(series: Column, window: int = 128, stride: int = 64) -> Column:
    """struct(mean, tail mean, smallest window mean, length); nulls for an empty series. The last partial stride counts."""
    n = F.size(series)
    end = F.slice(series, F.greatest(F.lit(1), n - (window - 1)), F.lit(window))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), n - (window - 1)) - 1, F.lit(stride))
    low = F.array_min(F.transform(starts, lambda s: _mean(F.slice(series, s + 1, window))))
    some = n > 0
    return F.struct(F.when(some, _mean(series)).alias("mean"), F.when(some, _mean(end)).alias("tail"), F.when(some, low).alias("min_group"), F.greatest(n, F.lit(0)).alias("ntok"))
