"""Chats: rendering to a template, prompt assembly, assistant-only label masks, batches of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsieve.operators import curation

# Fixed values of the chat template.
START, END = "<|im_start|>", "<|im_end|>\n"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_HEAD = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = (
    '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n'
    '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
IGNORED = -100


def collect_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, messages) of exploded turns, in order of turn."""
    rows = turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), "role", F.col("text").alias("content")))).alias("t"))
    return rows.select("id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def turn_text(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(END))


def _opening(messages: Column, tools: Column | None) -> Column:
    first = F.try_element_at(messages, F.lit(1))
    own = F.coalesce(first["role"] == "system", F.lit(False))
    if tools is None:
        return F.when(own, F.lit("")).otherwise(F.lit(START + "system\n" + DEFAULT_SYSTEM + END))
    head = F.when(own, first["content"]).otherwise(F.lit(DEFAULT_SYSTEM))
    listed = F.concat(F.lit(TOOLS_HEAD), F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), ""), F.lit(TOOLS_TAIL))
    return F.concat(F.lit(START + "system\n"), head, listed, F.lit(END))


def render(messages: Column, generation_prompt: bool = False, tools: Column | None = None, tool_calls: bool = False) -> Column:
    """A chat as one string. Without a leading system turn the default one is put first. With `tools` (array of
    JSON strings) the system turn lists them. With tool_calls, turns have a field tool_calls (array of struct
    name, arguments as JSON) and tool results, role `tool`, are wrapped into user turns."""

    def one(m: Column, i: Column) -> Column:
        plain = turn_text(m["role"], m["content"])
        if tools is not None:
            plain = F.when((i == 0) & (m["role"] == "system"), "").otherwise(plain)
        if not tool_calls:
            return plain
        call = lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
        said = F.when(F.coalesce(m["content"], F.lit("")) != "", F.concat(F.lit("\n"), m["content"])).otherwise("")
        calling = F.concat(F.lit(START + "assistant"), said, F.array_join(F.transform(m["tool_calls"], call), ""), F.lit(END))
        before, after = F.get(messages, i - 1)["role"], F.get(messages, i + 1)["role"]
        opens = F.when((i == 0) | ~before.eqNullSafe("tool"), START + "user").otherwise("")
        closes = F.when(~after.eqNullSafe("tool"), END).otherwise("")
        result = F.concat(opens, F.lit("\n<tool_response>\n"), m["content"], F.lit("\n</tool_response>"), closes)
        return F.when(m["role"] == "tool", result).when((m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0), calling).otherwise(plain)

    body = F.array_join(F.transform(messages, one), "")
    end = F.lit(START + "assistant\n" if generation_prompt else "")
    return F.concat(_opening(messages, tools), body, end)


def prompt_messages(system: Column, shots: Column, question: Column) -> Column:
    """System turn, few-shot turns (array of struct user, assistant) and the question."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    pairs = F.flatten(F.transform(shots, lambda s: F.array(turn("user", s["user"]), turn("assistant", s["assistant"]))))
    return F.concat(F.array(turn("system", system)), pairs, F.array(turn("user", question)))


def with_shots(questions: DataFrame, shots: DataFrame, system: Column, question: str = "question") -> DataFrame:
    """Questions with their prompt. shots (ord, user, assistant) is an exemplar file of a few rows; as one array
    it is a literal of the plan, so no join is needed."""
    rows = sorted((r["ord"], r["user"], r["assistant"]) for r in shots.select("ord", "user", "assistant").collect())  # the exemplar file
    turns = F.array(*[F.struct(F.lit(u).alias("user"), F.lit(a).alias("assistant")) for _, u, a in rows]) if rows else F.array().cast("array<struct<user:string,assistant:string>>")
    return questions.withColumn("messages", prompt_messages(system, turns, F.col(question)))


def pieces(messages: Column) -> Column:
    """array<struct<text, label>>: the turns that render() writes, without a generation prompt, cut into heads and bodies;
    label marks the bodies of assistant turns, content and end mark. Joined, they are the rendered chat."""
    piece = lambda text, label: F.struct(text.alias("text"), label.alias("label"))
    opening = F.array(piece(_opening(messages, None), F.lit(False)))
    turn = lambda m: F.array(piece(F.concat(F.lit(START), m["role"], F.lit("\n")), F.lit(False)), piece(F.concat(m["content"], F.lit(END)), F.coalesce(m["role"] == "assistant", F.lit(False))))
    return F.concat(opening, F.flatten(F.transform(messages, turn)))


def label_mask(messages: Column, max_length: int | None = None) -> Column:
    """array<struct<token, label>>: runs of non-space characters of the rendered chat; the label is the token inside an
    assistant turn's content and end mark, else null. No such run crosses a border of pieces, since each ends in a line end
    or an end mark. A chat over max_length becomes one ignored dummy."""
    words = lambda p: F.transform(F.regexp_extract_all(p["text"], F.lit(r"\S+"), F.lit(0)), lambda t: F.struct(t.alias("token"), F.when(p["label"], t).alias("label")))
    every = F.flatten(F.transform(pieces(messages), words))
    if max_length is None:
        return every
    dummy = F.array(F.struct(F.lit(END.strip()).alias("token"), F.lit(None).cast("string").alias("label")))
    return F.when(F.size(every) > max_length, dummy).otherwise(every)


#: From a text to the ids of its tokens and their (begin, end) in it.
Encoder = Callable[[str], tuple[list[int], list[tuple[int, int]]]]


def _masked(texts: list[str], marks: list[bool], encode: Encoder, max_length: int | None, end_id: int) -> tuple[list[int], list[int] | None, int | None]:
    whole = "".join(texts)
    ids, spans = encode(whole)
    if max_length is not None and len(ids) > max_length:
        return [end_id], [IGNORED], None
    labels, at, k = [IGNORED] * len(ids), 0, 0
    for text, mark in zip(texts, marks):
        if mark:
            places = []
            for border in (at, at + len(text)):
                while k < len(ids) and spans[k][1] <= border:
                    k += 1
                crossing = k < len(ids) and spans[k][0] < border
                # a token border isn't enough: the tokens before it must be those of the prefix by itself
                if crossing or border < len(whole) and encode(whole[:border])[0] != ids[:k]:
                    return ids, None, border
                places.append(k)
            labels[places[0] : places[1]] = ids[places[0] : places[1]]
        at += len(text)
    return ids, labels, None


def encoded_mask(messages: Column, load: Callable[[], Encoder], max_length: int | None = None, end_id: int = 0) -> Column:
    """struct<ids, labels, crossing> for any tokeniser. ids are those of the whole rendered chat; labels are the ids inside
    assistant turns and IGNORED elsewhere. Where the tokens up to the border of an assistant turn aren't the tokens of the
    text up to it, labels are null and crossing is that place in the text. A chat over max_length becomes one ignored
    `end_id`. load: gives the encoder, once a task; whole columns of pieces go to Python, ids come back."""

    @F.arrow_udf("struct<ids:array<int>,labels:array<int>,crossing:int>")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for batch in batches:
            rows = []
            for chat in batch.to_pylist():
                if chat is None or any(p["text"] is None for p in chat):
                    rows.append(None)
                    continue
                found = _masked([p["text"] for p in chat], [p["label"] for p in chat], encode, max_length, end_id)
                rows.append(dict(zip(("ids", "labels", "crossing"), found)))
            yield pa.array(rows, pa.struct([("ids", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("crossing", pa.int32())]))

    return mask(pieces(messages))


def trainable(mask: Column) -> Column:
    return F.exists(mask, lambda t: t["label"].isNotNull())


def pad_labels(labels: Column, multiple: int = 8, pad: int = IGNORED) -> Column:
    """Labels filled up to a multiple."""
    return F.concat(labels, F.array_repeat(F.lit(pad), F.pmod(-F.size(labels), F.lit(multiple)).cast("int")))


def length_batches(rows: DataFrame, length: Column, key: Column, size: int, multiple: int = 8, rows_per_part: int = 50_000) -> DataFrame:
    """rows with batch (gapless from 0, longest rows first, `size` rows each but the last), padded (the longest row of the
    batch, filled up to a multiple) and pads. Rows of one length come in the order of the SHA-256 of `key`.

    A row's place is how many rows are longer, how many of its length lie in earlier parts of the hash, and its place in its
    part; parts hold about rows_per_part rows, so no length is one task. Sums over lengths are as many as there are
    lengths. Rows equal in key and length come in any order; a null length counts as 0."""
    own = {n: curation.free_name([*rows.columns, "batch", "padded", "pads"], f"_{n}") for n in ("n", "hash", "part", "before", "longer", "place", "longest")}
    n, digest, part = F.col(own["n"]), F.col(own["hash"]), F.col(own["part"])
    marked = rows.withColumns({own["n"]: F.coalesce(length, F.lit(0)).cast("long"), own["hash"]: F.sha2(key.cast("string"), 256)})
    lengths = marked.groupBy(own["n"]).agg(F.count(F.lit(1)).alias("of"))
    lengths = lengths.select(own["n"], F.ceil(F.col("of") / rows_per_part).alias("parts"), (F.sum("of").over(Window.orderBy(n.desc())) - F.col("of")).alias(own["longer"]))
    share = F.conv(F.substring(F.coalesce(digest, F.lit("0")), 1, 8), 16, 10).cast("double") / 4294967296.0
    dealt = marked.join(lengths, own["n"]).withColumn(own["part"], F.floor(share * F.col("parts"))).drop("parts")
    counts = dealt.groupBy(own["n"], own["part"]).agg(F.count(F.lit(1)).alias("of"))
    before = counts.select(own["n"], own["part"], (F.sum("of").over(Window.partitionBy(own["n"]).orderBy(part)) - F.col("of")).alias(own["before"]))
    placed = dealt.withColumn(own["place"], F.row_number().over(Window.partitionBy(own["n"], own["part"]).orderBy(digest)) - 1).join(before, [own["n"], own["part"]])
    batch = F.floor((F.col(own["longer"]) + F.col(own["before"]) + F.col(own["place"])) / size).cast("long")
    placed = placed.select(*[c for c in rows.columns if c not in ("batch", "padded", "pads")], own["n"], batch.alias("batch"))
    longest = placed.groupBy("batch").agg(F.max(own["n"]).alias(own["longest"]))
    padded = (F.ceil(F.col(own["longest"]) / multiple) * multiple).cast("long")
    return placed.join(longest, "batch").withColumn("padded", padded).withColumn("pads", F.col("padded") - n).drop(own["n"], own["longest"])
