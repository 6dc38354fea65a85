import random
import re

import pytest
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.functions import blocks
from quillsieve.operators import chat, curation, nearness


def test_apportion():
    shape = {"Level 3": 150, "Level 4": 275, "Level 5": 275}
    assert curation.apportion(shape, 1200) == {"Level 3": 257, "Level 4": 472, "Level 5": 471}
    assert curation.apportion(shape, 700) == shape
    rng = random.Random(2)
    for _ in range(50):
        quotas = {f"k{i}": rng.randint(1, 50) for i in range(rng.randint(1, 6))}
        n = rng.randint(1, 400)
        assert sum(curation.apportion(quotas, n).values()) == n
    with pytest.raises(ValueError):
        curation.apportion(shape, 0)


def test_rejection_after_acceptance(spark):
    rows = [(0, "Same text", False), (1, "same TEXT!", True), (2, "same text", True), (3, "other", True), (4, "known", True), (5, "known", False)]
    df = spark.createDataFrame(rows, "ord int, text string, fine boolean")
    excluded = spark.createDataFrame([("known",)], "norm string")
    got = curation.rejection(df, [("bad", ~F.col("fine")), ("never", F.lit(None).cast("boolean"))], T.normalized(F.col("text")), excluded)
    assert [r["rejection"] for r in got.orderBy("ord").collect()] == ["bad", None, "external_duplicate", None, "external_duplicate", "external_duplicate"]
    kept = curation.first_accepted(df, T.normalized(F.col("text")), F.col("fine")).collect()
    assert sorted(r["ord"] for r in kept) == [1, 3, 4]


def test_contamination(spark):
    item = "find the sum of all positive integers n such that n squared plus n divides one hundred and twenty"
    rows = [(0, "!!"), (1, item.upper() + "."), (2, item + " today"), (3, "unrelated words only here and nothing else at all"), (4, item.replace("positive", "possitive").replace("hundred", "hundreds"))]
    got = {r["id"]: r["contamination"] for r in nearness.contamination(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(9, item)], "id int, text string")).collect()}
    assert got == {0: "empty", 1: "exact", 2: "near_token", 4: "near_sequence"}


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(40)], "id int, k string, text string")
    quotas = spark.createDataFrame([("a", 3), ("b", 5)], "k string, quota int")
    score = T.stable_score(1, F.col("k"), F.col("text"))
    one = curation.quota_sample(rows, "k", quotas, score, "id").collect()
    two = curation.quota_sample(rows.repartition(5), "k", quotas, score, "id").collect()
    assert sorted(one) == sorted(two) and [r["k"] for r in one].count("a") == 3 and len(one) == 8
    short = curation.short_strata(rows, "k", spark.createDataFrame([("a", 30), ("z", 1)], "k string, quota int"))
    assert sorted((r["k"], r["available"]) for r in short.collect()) == [("a", 20), ("z", 0)]
    assert len(curation.bottom_k(rows, F.sha2("text", 256), 7, "id").collect()) == 7
    ids = {r["id"] for r in curation.hash_split(rows, F.col("id"), 0.5, spark.createDataFrame([(1,)], "id int")).collect()}
    assert 1 not in ids and 5 < len(ids) < 35
    assert curation.hash_split(rows, F.col("id"), 1.0).count() == 40


def test_replicate_and_band(spark):
    rows = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", None)], "id string, teacher string")
    got = curation.replicate(rows, "teacher", spark.createDataFrame([("t1", 3), ("t2", 1)], "teacher string, repeats int")).collect()
    assert sorted((r["id"], r["training_repeat"]) for r in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)]
    pool = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    screened = spark.createDataFrame([("a", 2), ("b", 6), ("c", 7), ("d", 3)], "id string, n_correct int")
    assert sorted(r["id"] for r in curation.band_pool(pool, screened, spark.createDataFrame([("d",)], "id string"), 2, 6).collect()) == ["a", "b"]


def test_source_reason(spark):
    df = spark.createDataFrame([("olympiads", True, "5"), ("blog", False, "5"), ("olympiads", False, "x"), ("olympiads", False, "7")], "source string, synthetic boolean, answer string")
    apply = curation.source_reason([("synthetic", F.col("synthetic")), ("not_integer", T.curated_integer(F.col("answer")).isNull())], F.col("source") != "olympiads")
    assert [r["reason"] for r in apply(df).collect()] == ["synthetic", "not_integer", None]


def test_length_order(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (3, 9, 1, 7, 5)], "t string")
    assert [len(r["t"]) for r in curation.length_order(rows, F.length("t"), 1).collect()] == [9, 7, 5, 3, 1]


CHAT = "messages array<struct<role:string,content:string>>"


def test_render(spark):
    df = spark.createDataFrame([([("user", "hi")],), ([("system", "be"), ("user", "hi"), ("assistant", "yo")],)], CHAT)
    plain = [r["t"] for r in df.select(chat.render(F.col("messages"), True).alias("t")).collect()]
    assert plain[0] == f"<|im_start|>system\n{chat.DEFAULT_SYSTEM}<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert plain[1].startswith("<|im_start|>system\nbe<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n")
    tools = F.array(F.lit('{"name": "f"}'))
    told = df.select(chat.render(F.col("messages"), tools=tools).alias("t")).collect()[1]["t"]
    assert told.startswith("<|im_start|>system\nbe\n\n# Tools") and '\n{"name": "f"}\n</tools>' in told and told.count("<|im_start|>system") == 1


def test_render_tool_calls(spark):
    kind = "messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"
    rows = [([("user", "q", None), ("assistant", "", [("f", '{"x": 1}')]), ("tool", "1", None), ("tool", "2", None), ("assistant", "done", None)],)]
    t = spark.createDataFrame(rows, kind).select(chat.render(F.col("messages"), tool_calls=True).alias("t")).first()["t"]
    assert '<|im_start|>assistant\n<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call><|im_end|>\n' in t
    assert "<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n<|im_start|>assistant\ndone<|im_end|>\n" in t


def test_masks(spark):
    df = spark.createDataFrame([([("user", "a b"), ("assistant", "c d"), ("user", "e"), ("assistant", "f")],), ([("user", "a")],)], CHAT)
    masks = [r["m"] for r in df.select(chat.label_mask(F.col("messages")).alias("m")).collect()]
    assert [t["label"] for t in masks[0] if t["label"]] == ["c", "d<|im_end|>", "f<|im_end|>"]
    assert [r["k"] for r in df.select(chat.trainable(chat.label_mask(F.col("messages"))).alias("k")).collect()] == [True, False]
    assert df.select(chat.trainable(chat.label_mask(F.col("messages"), max_length=3)).alias("k")).first()["k"] is False
    padded = spark.createDataFrame([([1] * 5,), ([1] * 8,), ([],)], "l array<int>").select(F.size(chat.pad_labels(F.col("l"))).alias("n")).collect()
    assert [r["n"] for r in padded] == [8, 8, 0]


CHATS = [
    [("user", "a b"), ("assistant", "c d"), ("user", "e"), ("assistant", "f\n\n")],
    [("system", "be brief"), ("user", "a 12"), ("assistant", ""), ("user", "x"), ("assistant", "don't 3.5 é ß 日本")],
    [("user", "a")],
    [("assistant", "first"), ("user", "then")],
    [("user", "q"), ("assistant", "  begins with spaces")],
    [],
]


def test_pieces_are_the_rendered_chat(spark):
    df = spark.createDataFrame([(c,) for c in CHATS], CHAT)
    for r in df.select(chat.render(F.col("messages")).alias("t"), chat.pieces(F.col("messages")).alias("p"), chat.label_mask(F.col("messages")).alias("m")).collect():
        assert "".join(p["text"] for p in r["p"]) == r["t"]
        assert [t["token"] for t in r["m"]] == re.findall(r"\S+", r["t"])


def prefix_method(messages, encode):
    """Labels by rendering and encoding each turn's prefix anew; None where it isn't one."""
    opening = "" if messages and messages[0][0] == "system" else chat.START + "system\n" + chat.DEFAULT_SYSTEM + chat.END
    render = lambda m: opening + "".join(chat.START + role + "\n" + content + chat.END for role, content in m)
    ids = encode(render(messages))[0]
    labels = [chat.IGNORED] * len(ids)
    for k, (role, _) in enumerate(messages):
        if role == "assistant":
            before, upto = encode(render(messages[:k]) + chat.START + "assistant\n")[0], encode(render(messages[: k + 1]))[0]
            if ids[: len(before)] != before or ids[: len(upto)] != upto:
                return ids, None
            labels[len(before) : len(upto)] = ids[len(before) : len(upto)]
    return ids, labels


def load_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def encode(text):
        found = bpe.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    return encode


def test_encoded_mask_is_the_prefix_method(spark):
    """Subword tokens and runs of one class; a turn that begins with spaces shares a token with its head."""
    from quillsieve.plans.catalogue import class_encoder

    pytest.importorskip("tokenizers")
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(CHATS)], "k int, " + CHAT).repartition(2)
    for load in (load_bpe, class_encoder):
        encode = load()
        found = {r["k"]: r["m"] for r in rows.select("k", chat.encoded_mask(F.col("messages"), load).alias("m")).collect()}
        for k, messages in enumerate(CHATS):
            ids, labels = prefix_method(messages, encode)
            assert found[k]["ids"] == ids and found[k]["labels"] == labels and (found[k]["crossing"] is None) == (labels is not None)
        assert load is load_bpe or found[4]["labels"] is None and found[0]["labels"] is not None
    short = {r["k"]: r["m"] for r in rows.select("k", chat.encoded_mask(F.col("messages"), class_encoder, 60, 7).alias("m")).collect()}
    assert short[1]["ids"] == [7] and short[1]["labels"] == [chat.IGNORED]
    nothing = spark.createDataFrame([([("user", None)],), (None,)], CHAT).select(chat.encoded_mask(F.col("messages"), class_encoder).alias("m"))
    assert [r["m"] for r in nothing.collect()] == [None, None]


@pytest.mark.parametrize("part", [50_000, 7])
def test_length_batches(spark, part):
    """Gapless batches, longest first, one padded length each; one length has a third of the rows and lies in many parts."""
    import hashlib

    rng = random.Random(9)
    rows = [(k, 40 if k % 3 == 0 else rng.choice([None, 0, 1, 8, 9, 63, 200]), "own", "own") for k in range(150)] + [(7, 8, "own", "own")] * 2
    df = spark.createDataFrame(rows, "k int, n int, batch string, _n string").repartition(4)
    found = chat.length_batches(df, F.col("n"), F.col("k"), 8, 16, part).collect()
    order = sorted(rows, key=lambda r: (-(r[1] or 0), hashlib.sha256(str(r[0]).encode()).hexdigest()))
    want = []
    for b in range(0, len(order), 8):
        longest = order[b][1] or 0
        padded = -(-longest // 16) * 16
        want += [(r[0], r[1] or 0, b // 8, padded, padded - (r[1] or 0)) for r in order[b : b + 8]]
    assert sorted((r["k"], r["n"] or 0, r["batch"], r["padded"], r["pads"]) for r in found) == sorted(want)
    assert {r["_n"] for r in found} == {"own"} and chat.length_batches(df.limit(0), F.col("n"), F.col("k"), 8).count() == 0


def test_collect_and_shots(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id int, turn int, role string, text string")
    assert [tuple(m) for m in chat.collect_chats(turns).first()["messages"]] == [("user", "a"), ("assistant", "b")]
    shots = spark.createDataFrame([(1, "q2", "a2"), (0, "q1", "a1")], "ord int, user string, assistant string")
    got = chat.with_shots(spark.createDataFrame([("q",)], "question string"), shots, F.lit("s")).first()["messages"]
    assert [m["content"] for m in got] == ["s", "q1", "a1", "q2", "a2", "q"]


def test_small_selections(spark):
    rows = spark.createDataFrame([("a", 0, 3), ("a", 2, None), ("b", 1, 5)], "id string, ord int, support int")
    assert sorted(map(tuple, curation.last_write(rows).collect())) == [("a", 2, None), ("b", 1, 5)]
    assert [r["ord"] for r in curation.first_rows(rows, 2).collect()] == [0, 1]
    assert [curation.support_range(rows, *b).count() for b in ((None, None), (1, None), (None, 3), (1, 4))] == [3, 2, 2, 1]


def test_rendered_prompt_styles(spark):
    from quillsieve.operators.rollouts import cut_off

    df = spark.createDataFrame([("length",), ("stop",), (None,)], "r string")
    assert [r["c"] for r in df.select(cut_off(F.col("r")).alias("c")).collect()] == [True, False, False]


def test_apportioned_table(spark):
    rng = random.Random(5)
    for _ in range(4):
        quotas, n = {f"k{i}": rng.randint(1, 50) for i in range(rng.randint(1, 9))}, rng.randint(1, 400)
        strata = spark.createDataFrame(list(quotas.items()), "name string, q bigint")
        assert {r["name"]: r["quota"] for r in curation.apportioned(strata, "name", "q", n).collect()} == curation.apportion(quotas, n)


def test_strict_pool(spark):
    from quillsieve.operators.checks import CheckError

    pool, screened, none = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 2), (2, 2)], "id int, n_correct int"), spark.createDataFrame([], "id int")
    assert curation.band_pool(pool, screened, none, 1, 3).count() == 1
    with pytest.raises(CheckError):
        curation.band_pool(pool, screened, none, 1, 3, strict=True)


def test_merge(spark):
    from quillsieve.operators.checks import CheckError

    a = spark.createDataFrame([("1", "x", "t1"), ("2", "y", "t2")], "id string, text string, teacher string")
    b = spark.createDataFrame([("3", "zz", "t2")], "id string, text string, teacher string")
    repeats = spark.createDataFrame([("t2", 2)], "teacher string, repeats int")
    rows = curation.merge([a, b], "teacher", repeats, F.length("text"), 2).select("id", "training_repeat").collect()
    assert sorted(map(tuple, rows)) == [("1", 1), ("2", 1), ("2", 2), ("3", 1), ("3", 2)]
    same, other = a.filter("id = '1'"), a.filter("id = '1'").withColumn("text", F.lit("w"))
    unknown = spark.createDataFrame([("t9", 2)], "teacher string, repeats int")
    for parts, times, limit, said in (([a, same], repeats, 2, "more than once"), ([a, other], repeats, 2, "conflicting"), ([a, b], repeats, 1, "longer"), ([a, b], unknown, 2, "unknown")):
        with pytest.raises(CheckError, match=said):
            curation.merge(parts, "teacher", times, F.length("text"), limit)


def test_prefix_pairs_lose_nothing(spark):
    import random

    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 25))] for _ in range(25)]
    texts = base + [[w if rng.random() > 0.06 else "zz" for w in b] for b in base * 3] + [["", "the"], ["the"], []]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id int, text string")
    found = {tuple(r) for r in nearness.prefix_pairs(docs, docs).collect()}
    sets = [set(re.findall(r"[a-z]+|\d+", " ".join(t))) for t in texts]
    near = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert near <= found


def test_blocks_equal_difflib():
    from difflib import SequenceMatcher

    rng = random.Random(8)
    say = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for letters in ("a", "ab", "abc ", "abcdefghijklmnopqrstuvwxyz "):
        for _ in range(150):
            a, b = say(rng.randint(0, 40), letters), say(rng.randint(0, 40), letters)
            if rng.random() < 0.5:
                b = a[: rng.randint(0, 40)] + say(rng.randint(0, 4), letters) + a[rng.randint(0, 40) :]
            m = SequenceMatcher(None, a, b, autojunk=False)
            block = m.find_longest_match()
            assert blocks.longest_block(a, b) == (block.a, block.b, block.size) or not block.size
            assert blocks.ratio(a, b) == m.ratio()
            for least in (0.0, 0.5, 0.85, 0.92, 1.0):
                assert blocks.reaches(a, b, least) == (m.ratio() >= least)
    long = " ".join(say(rng.randint(1, 9), "abcdefghij") for _ in range(6000))
    assert blocks.reaches(long, long.replace("abc", "bca"), 0.9) and not blocks.reaches(long, long[::-1], 0.9)


def test_pairs_are_made_once(spark):
    """A passage of 100 words in many texts makes one row a pair, although it gives 96 shingles; two passages two."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two = say(100), say(40)
    left = [(k, f"{say(9)} {one if k % 2 else ''} {say(5)} {two if k % 3 == 0 else ''}") for k in range(60)] + [(99, ""), (98, None), (97, "a b")]
    right = [(k, f"{say(4)} {one} {say(3)} {two}") for k in range(5)] + [(7, "a b"), (8, None)]
    a, b = spark.createDataFrame(left, "id int, text string"), spark.createDataFrame(right, "id int, text string")
    want = {(i, j) for i in range(60) for j in range(5) if i % 2 or i % 3 == 0} | {(97, 7)}
    made = [tuple(r) for r in nearness.shingle_rows(a, b).collect()]
    assert set(made) == want and len(made) == len(want) + sum(5 for i in range(60) if i % 2 and i % 3 == 0)
    assert {tuple(r) for r in nearness.shingle_pairs(a, b).collect()} == want
    alike = {tuple(r) for r in nearness.shingle_pairs(a, b, alike=True).collect()}
    n = {k: len(t.split()) for k, t in left if t}, {k: len(t.split()) for k, t in right if t}
    assert alike == {(i, j) for i, j in want if min(n[0][i], n[1][j]) >= 0.8 * max(n[0][i], n[1][j])}


def test_few_pairs_reach_python(spark):
    """Of texts that share a passage, only those that letters allow are compared as sequences."""
    rng = random.Random(7)
    say = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    shared = say(8, "abcdefghijklmnop")
    texts = [(k, shared + " " + say(40, "abcdefghijklmnop"[k % 8 : k % 8 + 8])) for k in range(60)]
    texts += [(100, shared + " " + say(40, "abcd")), (101, None)]
    items = [(0, texts[-2][1].replace("a", "aa", 3)), (1, texts[0][1][::-1])]
    left, right = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(items, "id int, text string")
    pairs = nearness.shingle_pairs(left, right, alike=True)
    assert pairs.count() >= 50
    asked = nearness.bounded_pairs(pairs, left, right).filter("sequence_may").collect()
    assert {(r["left_id"], r["right_id"]) for r in asked} == {(100, 0)}
    assert [tuple(r)[:2] for r in nearness.near_matches(pairs, left, right).collect()] == [(100, 0)]


def test_verdicts_by_text(spark):
    """Rows of one id are judged each by its own text; rows of one text share the verdict and stay as many."""
    from quillsieve.plans import curate

    item = "find the sum of all positive integers n such that n squared plus n divides one hundred and twenty"
    rows = [(0, "a", item, "s"), (1, "a", "a clean question of its own about seven green apples", "s"), (2, "b", item, "s"), (3, "b", item, "s"), (4, "c", item + " today", "s"), (5, None, None, "s")]
    df = spark.createDataFrame(rows, "ord int, id string, question string, lang string").withColumn("solution", F.repeat(F.lit("x "), 70))
    official = spark.createDataFrame([(item,)], "text string")
    assert sorted((r["id"] or "", r["contamination"]) for r in nearness.contamination(df.withColumnRenamed("question", "text"), official).collect()) == [("", "empty"), ("a", "exact"), ("b", "exact"), ("b", "exact"), ("c", "near_token")]
    judged = curate.judge([curate.Source("s", df, {"s": 1}, "lang")], official)
    found = {r["place"]["ord"]: r["rejection"] for r in judged.collect()}
    assert len(found) == judged.count() == 6
    assert found == {0: "official_exact", 1: None, 2: "official_exact", 3: "official_exact", 4: "official_near_token", 5: "official_empty"}


def test_odd_column_names(spark):
    """Columns with the names that operators use themselves come through."""
    names = ["_key", "_score", "_place", "_failed", "_known", "_first", "_times", "quota", "repeats", "norm", "_length", "new"]
    rows = spark.createDataFrame([(k, f"t{k % 3}", "en") for k in range(6)], "ord int, text string, lang string").withColumns({n: F.lit(n) for n in names})
    kept = lambda df, but=(): all(df.filter(F.col(n) != n).isEmpty() for n in names if n not in but) and set(names) <= set(df.columns)
    judged = curation.rejection(rows, [("short", F.length("text") < 1)], F.col("text"), rows.filter("ord = 0").select(F.col("text").alias("norm")))
    assert kept(judged, ("norm",)) and {r["ord"]: r["rejection"] for r in judged.collect()} == {0: "external_duplicate", 1: None, 2: None, 3: "external_duplicate", 4: "external_duplicate", 5: "external_duplicate"}
    quotas = spark.createDataFrame([("en", 2)], "lang string, quota int")
    assert kept(curation.quota_sample(rows, "lang", quotas, F.col("text"), "ord")) and curation.quota_sample(rows, "lang", quotas, F.col("text"), "ord").count() == 2
    assert kept(curation.bottom_k(rows, F.col("text"), 2, "ord")) and kept(curation.length_order(rows, F.length("text"), 2))
    assert kept(curation.replicate(rows, "lang", spark.createDataFrame([("en", 2)], "lang string, repeats int")))


def test_contamination_kinds(spark):
    from difflib import SequenceMatcher

    official = ["the little house by our own long green river is where we made the fine white cheese before the war came to the place", "one two three four five six seven eight nine ten"]
    texts = [official[0], official[0] + " indeed", re.sub(r"e\b", "ee", official[0]), "", "something else altogether", official[1].replace("ten", "eleven")]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    got = {r["id"]: r["contamination"] for r in nearness.contamination(frame(texts), frame(official)).collect()}
    ratio = SequenceMatcher(None, texts[2], official[0], autojunk=False).ratio()
    assert ratio >= 0.92 and got == {0: "exact", 1: "near_token", 2: "near_sequence", 3: "empty", 5: "near_sequence"}
