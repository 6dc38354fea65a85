import hashlib
import json
import random
import shutil
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import rollouts as R
from quillsieve.operators.checks import CheckError
from quillsieve.plans import compose
from quillsieve.plans.catalogue import printed
from quillsieve.plans.scratch import stored
from quillsieve.sources import jsondoc, readers, sinks
from quillsieve.streaming.resume import enrich_stream


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes('﻿id,question,answer\na,"two\nlines ""q""",5\nb,x,\n'.encode())
    rows = readers.read_csv(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in rows] == [("a", 'two\nlines "q"', "5"), ("b", "x", None)]
    assert readers.read_rows(spark, str(tmp_path / "p.csv"), "id string").count() == 2


def test_jsonl(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": "a", "counts": {"7": 2}}\n\n{"id": "b"}\n')
    rows = readers.read_rows(spark, str(path), "id string, counts map<string,long>").collect()
    assert [(r["id"], r["counts"]) for r in rows] == [("a", {"7": 2}), ("b", None)]
    out = str(tmp_path / "out")
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "id string, x int"), out)
    assert [json.loads(r["value"]) for r in spark.read.text(out).collect()] == [{"id": "é", "x": None}]


def test_validating_reader(spark, tmp_path):
    schema = "id string, prediction string"
    good, bad, twice, word = (tmp_path / n for n in ("good", "bad", "twice", "word"))
    good.write_text('{"id": "a", "prediction": "007"}\n\n{"id": "b", "prediction": null}\n')
    assert [tuple(r) for r in readers.read_predictions(spark, str(good), schema, stored).collect()] == [("a", "7"), ("b", None)]
    bad.write_text('{"id": "a"}\n{"id": \n')
    twice.write_text('{"id": "a"}\n{"id": "a"}\n')
    word.write_text('{"id": "a", "prediction": "five"}\n')
    for path, said in ((bad, "'line': 2"), (twice, "duplicate"), (word, "integer")):
        with pytest.raises(CheckError, match=said):
            readers.read_predictions(spark, str(path), schema, stored)


def test_submissions(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id,answer\na,1\nb,-02\n")
    assert [tuple(r) for r in readers.read_submission(spark, str(path)).collect()] == [("a", "1"), ("b", "-2")]
    other = tmp_path / "o.csv"
    other.write_text("key,value\na,9\n")
    with pytest.raises(CheckError):
        readers.read_answers(spark, str(other))
    for text in ("question,id,answer\nq1,a, 1.0\nq2,b,none\n", "id,guess\na,+01\nb,\n"):
        path.write_text(text)
        assert [tuple(r) for r in readers.read_answers(spark, str(path)).collect()] == [("a", "1"), ("b", None)]
    path.write_text("id,answer\na,1\nb,-02\n")
    with pytest.raises(CheckError):
        readers.read_submission(spark, str(other))
    df = spark.createDataFrame([(1, "b", None, "q2"), (0, "a", "5", "q1")], "ord int, id string, answer string, question string")
    assert sinks.write_submission(df, str(tmp_path / "w")) == 1
    assert [r["value"] for r in spark.read.text(str(tmp_path / "w")).collect()] == ["id,answer", "a,5", "b,0"]
    sinks.write_replaced(df, spark.createDataFrame([("b", "8")], "id string, answer string"), str(tmp_path / "k"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "k")).collect()] == ["id,answer,question", "a,5,q1", "b,8,q2"]
    missing = sinks.write_stages(df.withColumnRenamed("answer", "c1"), {"c1": str(tmp_path / "c1")})
    assert missing == {"c1": 1}


def test_pools_documents_bands(spark, tmp_path):
    (tmp_path / "p1.jsonl").write_text('{"id": "a"}\n')
    schema, paths = "id string", [str(tmp_path / "p1.jsonl"), str(tmp_path / "p2.jsonl")]
    assert [tuple(r) for r in readers.read_pools(spark, paths, schema).collect()] == [("a", "p1.jsonl")]
    assert readers.read_pools(spark, paths[1:], schema).count() == 0
    with pytest.raises(CheckError):
        readers.read_pools(spark, paths, schema, optional=False)
    (tmp_path / "e.json").write_text('[{"user": "u1", "assistant": "a1"}, {"user": "u2", "assistant": "a2"}]')
    assert [(r["ord"], r["user"]) for r in readers.read_json_document(spark, str(tmp_path / "e.json"), "user string, assistant string").collect()] == [(0, "u1"), (1, "u2")]
    problems = spark.createDataFrame([("a", "q", None, 2), ("b", "r", "5", 9)], "id string, question string, answer string, votes int")
    sinks.write_bands(problems, {"low": F.col("votes") <= 3, "all": F.lit(True)}, str(tmp_path / "bands"))
    assert spark.read.option("header", True).csv(str(tmp_path / "bands")).groupBy("band").count().filter("band = 'all'").first()["count"] == 2
    sinks.write_manifest(problems, str(tmp_path / "m"), quotas={"x": 1})
    (tmp_path / "emitted").mkdir()
    (tmp_path / "emitted" / "part-0.csv").write_bytes(b"id\na\n")
    sinks.write_manifest(problems, str(tmp_path / "m2"), str(tmp_path / "emitted"))
    told = json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m2")).collect()))
    assert told["files"] == {"part-0.csv": hashlib.sha256(b"id\na\n").hexdigest()}
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()))["rows"] == 2
    spark.range(3).write.parquet(str(tmp_path / "corpus" / "rev1"))
    assert readers.read_pinned(spark, str(tmp_path / "corpus"), "rev1").count() == 3
    with pytest.raises(CheckError):
        readers.read_pinned(spark, str(tmp_path / "corpus"), "rev2")


def test_append_and_resume(spark, tmp_path):
    log = str(tmp_path / "log")
    work = spark.createDataFrame([(i,) for i in range(6)], "id int")
    sinks.append_rows(work.filter("id < 2"), log)
    left = R.remaining(work, readers.read_jsonl(spark, log, "id int"))
    assert sorted(r["id"] for r in left.collect()) == [2, 3, 4, 5]


def test_stream(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id int"
    spark.range(3).selectExpr("cast(id as int) id").write.json(source)
    enrich = lambda df: df.withColumn("twice", F.col("id") * 2)
    assert enrich_stream(spark, source, schema, target, mark, enrich).count() == 3
    spark.range(1, 5).selectExpr("cast(id as int) id").write.mode("append").json(source)
    out = enrich_stream(spark, source, schema, target, mark, enrich)
    assert sorted(map(tuple, out.select("id", "twice").collect())) == [(i, 2 * i) for i in range(5)]


def test_stream_reads_no_target(spark, tmp_path):
    """What was written may go; its ids are still done. An empty source gives an empty table."""
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(0).selectExpr("id").write.json(source)
    enrich = lambda df: df.withColumn("twice", F.col("id") * 2)
    assert enrich_stream(spark, source, "id long", target, mark, enrich).collect() == []
    spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id long").write.mode("append").option("ignoreNullFields", False).json(source)
    assert sorted(map(tuple, enrich_stream(spark, source, "id long", target, mark, enrich).select("id", "twice").collect()), key=repr) == [(1, 2), (2, 4), (None, None)]
    shutil.rmtree(target)
    spark.range(1, 4).write.mode("append").json(source)
    assert [r["id"] for r in enrich_stream(spark, source, "id long", target, mark, enrich).collect()] == [3]


def test_stream_attempts(spark, tmp_path):
    """Failed rows come back with one attempt more until none is left; others aren't asked again."""
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(6).write.json(source)
    enrich = lambda df: df.withColumn("error", F.when(F.col("attempt") <= F.col("id") - 3, "busy"))
    found = []
    for _ in range(4):
        out = enrich_stream(spark, source, "id long", target, mark, enrich, error_col="error", attempts=2)
        found.append(sorted((r["id"], r["attempt"], r["error"]) for r in out.collect()))
        spark.range(6).write.mode("append").json(source)
    first = [(0, 1, None), (1, 1, None), (2, 1, None), (3, 1, None)]
    assert found == [first, *[[*first, (4, 2, None), (5, 2, "busy")]] * 3]


def test_stream_state_expires(spark, tmp_path):
    """With times, ids are kept as long as asked; rows beyond that are an error, not a silent loss."""
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, at timestamp"
    enrich = lambda df: df.select("id", "at")

    def feed(*rows):
        spark.createDataFrame([(i, datetime(2024, 1, d)) for i, d in rows], schema).coalesce(1).write.mode("append").json(source)
        return sorted(r["id"] for r in enrich_stream(spark, source, schema, target, mark, enrich, time_col="at", keep="2 days").collect())

    assert feed((1, 1), (2, 2)) == [1, 2]
    assert feed((1, 2), (3, 10)) == [1, 2, 3]
    assert feed((4, 11), (2, 11)) == [1, 2, 2, 3, 4]  # forgotten by then, so done again
    with pytest.raises(CheckError, match="1 rows are later"):
        feed((9, 3))


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of 500 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbered_lines_of_split_files(spark, tmp_path, small_ranges):
    texts = {"a.jsonl": [f"line {k} " + "x" * (k * 37 % 90) for k in range(200)], "b.jsonl": ["", "é" * 300, "", "end"], "c.jsonl": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    found = readers.numbered_lines(spark, str(tmp_path), stored).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in found) == [(name, k + 1, x) for name in texts for k, x in enumerate(texts[name])]
    assert [r["value"] for r in sorted(found, key=lambda r: r["place"])] == texts["a.jsonl"] + texts["b.jsonl"] and {r["place"] for r in found} == set(range(1, 205))


def test_problems_name_their_line(spark, tmp_path, small_ranges):
    """Each kind of problem on a file of many ranges, the second file's first line among them."""
    rows = [{"id": f"q{k}", "prediction": str(k)} for k in range(120)]
    lines = [json.dumps(r) for r in rows]
    lines[17], lines[40], lines[63], lines[100], lines[111] = '{"id": ', '{"prediction": "1"}', '{"id": "q63", "prediction": "3.5"}', '{"id": "q5", "prediction": "x"}', "[1]"
    lines.insert(20, "  ")
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"id": "q7"}\r\n{"id": "new", "prediction": null}\r\n')
    good, bad = readers.checked_predictions(spark, str(tmp_path), "id string, prediction string", stored)
    found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["problem"]) for r in bad.collect())
    assert found == [("a.jsonl", 18, "not a JSON object"), ("a.jsonl", 42, "no id"), ("a.jsonl", 65, "prediction isn't an integer"), ("a.jsonl", 102, "duplicate id"), ("a.jsonl", 102, "prediction isn't an integer"), ("a.jsonl", 113, "not a JSON object"), ("b.jsonl", 1, "duplicate id")]
    with pytest.raises(CheckError, match="18"):
        readers.read_predictions(spark, str(tmp_path), "id string, prediction string", stored)


def odd_value(rng, depth=0):
    """A JSON value with commas, quotes, brackets and escapes inside its strings and keys."""
    text = lambda: "".join(rng.choice('ab,"\\{}[]: \né日') for _ in range(rng.randint(0, 12)))
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == 5:
        return {text(): odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return [None, True, rng.randint(-9, 10**9), text()][kind]


@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_document_elements(spark, tmp_path, small_ranges, style):
    """Elements of a document cut into ranges of 500 bytes, one of them longer than several ranges."""
    rng = random.Random(21)
    rows = [odd_value(rng) for _ in range(60)] + [{"long": ["x, y " * 300, {"z": list(range(400))}]}, "s" * 1500] + [odd_value(rng) for _ in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(rows, **style))
    found = jsondoc.elements(spark, str(tmp_path / "a.json"), 1).collect()
    assert [json.loads(r["text"]) for r in sorted(found, key=lambda r: r["element"])] == rows and sorted(r["element"] for r in found) == list(range(len(rows)))
    maps = {f"map {k}": {f'id,{n} "q"': odd_value(rng) for n in range(60)} for k in range(4)} | {"none": {}}
    (tmp_path / "b.json").write_text(json.dumps(maps, **style))
    back = {}
    for r in jsondoc.elements(spark, str(tmp_path / "b.json"), 2).collect():
        back.setdefault(r["path"][0], {}).update(json.loads("{" + r["text"] + "}"))
    assert back == {k: m for k, m in maps.items() if m}


def test_documents_of_parts(spark, tmp_path, small_ranges):
    """What many tasks write is one document of JSON, and is read back by many."""
    rows = [(k, f"u{k}, {{", None if k % 3 else 'q"') for k in range(150)]
    jsondoc.write_array(spark.createDataFrame(rows, "ord int, user string, assistant string").repartition(7), str(tmp_path / "array"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert [(k, r["user"], r["assistant"]) for k, r in enumerate(json.loads(whole))] == rows
    found = readers.read_json_document(spark, str(tmp_path / "array"), "user string, assistant string")
    assert sorted(map(tuple, found.collect())) == rows
    maps = [(n, f"id,{k}", k) for n in ("support", "votes") for k in range(90)]
    jsondoc.write_maps(spark.createDataFrame(maps, "name string, key string, value long"), str(tmp_path / "maps"), ["support", "votes", "nrisky"])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "maps").glob("part-*")))
    assert json.loads(whole) == {"support": {f"id,{k}": k for k in range(90)}, "votes": {f"id,{k}": k for k in range(90)}, "nrisky": {}}
    assert sorted(map(tuple, compose.read_bands(spark, str(tmp_path / "maps")).collect())) == sorted((f"id,{k}", k, k, None) for k in range(90))


@pytest.mark.parametrize("text", ["[1, 2", '{"a": "b', "[1]]"])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="document ends|more brackets"):
        jsondoc.elements(spark, str(tmp_path / "a.json"), 1)


def test_empty_documents(spark, tmp_path):
    for k, text in enumerate(["", "[]", " [ ] ", "{}", "7"]):
        (tmp_path / f"{k}.json").write_text(text)
        assert jsondoc.elements(spark, str(tmp_path / f"{k}.json"), 1).count() == 0
    assert jsondoc.elements(spark, str(tmp_path / "1.json"), 2).count() == 0


def test_ordered_parts(spark, tmp_path):
    """Many parts in order are byte by byte one file; the header comes once, of an empty table too."""
    rows = [(k * 7 % 501, f'n"{k}, ' if k % 3 else None, "" if k % 5 == 0 else "é\\") for k in range(501)]
    df = spark.createDataFrame(rows, "ord int, name string, more string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_ordered(df, str(tmp_path / "parts"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 2
    df.orderBy("ord").drop("ord").coalesce(1).write.option("header", True).csv(str(tmp_path / "one"))
    one = next((tmp_path / "one").glob("part-*")).read_bytes()
    assert b"".join(p.read_bytes() for p in parts) == one
    assert sinks.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "joined")) is False
    assert (tmp_path / "joined").read_bytes() == one
    sinks.write_ordered(df.limit(0), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "none").glob("part-*"))) == b"name,more\n"


def test_parts_too_large_to_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "COPY_BYTES", 3)
    spark.createDataFrame([("abcd",)], "value string").write.text(str(tmp_path / "parts"))
    with pytest.raises(CheckError, match="stay in"):
        sinks.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "joined"))
    assert not (tmp_path / "joined").exists()


def test_tree_digest(spark, tmp_path, small_ranges):
    """Against a plain tree, whatever the ranges; one changed line changes it."""
    def tree(lines, fan):
        level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
        while True:
            level = [hashlib.sha256("".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
            if len(level) == 1:
                return level[0]

    lines = [f"row {k} " * (k % 9) for k in range(300)]
    for name, body in (("a", lines), ("b", lines[:-1] + ["other"]), ("c", ["one"])):
        (tmp_path / name).write_text("\n".join(body))
    for fan in (4, 4096):
        found = {r["file"][-1]: r for r in sinks.tree_digests(readers.numbered_lines(spark, str(tmp_path), stored), stored, fan).collect()}
        assert {k: (r["lines"], r["digest"]) for k, r in found.items()} == {"a": (300, tree(lines, fan)), "b": (300, tree(lines[:-1] + ["other"], fan)), "c": (1, tree(["one"], fan))}
        assert found["a"]["bytes"] == len("\n".join(lines)) + 1


def test_program_runs():
    assert R.run_program("print(6 * 7)", 20) == ("ok", "42\n", "")
    status, _, err = R.run_program("1 // 0", 20)
    assert status == "error" and "ZeroDivisionError" in err
    assert R.run_program("import socket\nsocket.socket()", 20)[0] == "error"
    assert R.run_program("while True: pass", 0.5)[0] == "timeout"
    for code in ("import socket\nsocket.create_connection(('127.0.0.1', 9))", "import urllib.request\nurllib.request.urlopen('http://127.0.0.1:9')", "import os\nos.system('true')", "import subprocess\nsubprocess.run(['true'])"):
        status, _, err = R.run_program(code, 20)
        assert status == "error" and "not allowed" in err
    assert R.run_program("import sys\nsys.exit(3)", 20)[0] == "error"
    assert R.run_program("print('x' * 9_000_000 + 'end')", 20)[1] == "x" * 1996 + "end\n"
    assert R.run_program("open('big', 'wb').write(bytes(10**8))", 20)[0] == "error"


def test_programs_leave_nothing_running(tmp_path):
    """What a program forks ends with it, in time or not."""
    import time

    for after, status in (("", "ok"), ("time.sleep(60)", "timeout")):
        mark = tmp_path / f"alive-{status}"
        code = f"import os, time\nif not os.fork():\n    time.sleep(3)\n    open({str(mark)!r}, 'w')\n    os._exit(0)\n{after}"
        assert R.run_program(code, 1.5)[0] == status
        time.sleep(3)
        assert not mark.exists()


def test_http_provider():
    """Texts in order of index, cut ones marked, a refused request is an overflow."""
    import json
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code, answer = 200, {"choices": [{"index": 1, "message": {"content": None}, "finish_reason": "length"}, {"index": 0, "message": {"content": f"{asked['seed']} {self.path}"}, "finish_reason": "stop"}], "usage": {"completion_tokens": 10}}
            if asked["max_tokens"] > 600:
                code, answer = 400, {"error": "maximum context length"}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    provider = R.HttpProvider(f"http://127.0.0.1:{server.server_port}/v1/", "m", timeout=10)
    expected = [("4 /v1/chat/completions", 5, False), ("", 5, True)]
    assert provider.generate([{"role": "user", "content": "?"}], 2, 500, 4) == expected
    assert R.call_with_backoff(provider, [{"role": "user", "content": "?"}], 3, 2000, 4) == [*expected, ("", 0, False)]
    assert R.call_with_backoff(provider, [{"role": "user", "content": "?"}], 1, 20000, 4) == [("", 0, False)]
    server.shutdown()


class Narrow:
    """Overflows until the budget is small."""

    def generate(self, messages, n, max_tokens, seed):
        if max_tokens > 600:
            raise R.ContextOverflow
        return [(f"{max_tokens}:{len(messages[0]['content'])}", 1, False)]


class Broken:
    def generate(self, messages, n, max_tokens, seed):
        if messages[-1]["content"] == "bad":
            raise RuntimeError("no")
        return [("fine", 1, True)] * n


def test_backoff_and_isolation(spark):
    long = [{"role": "assistant", "content": "x" * 2000}]
    assert R.call_with_backoff(Narrow(), long, 2, 1200, 0) == [("600:1500", 1, False), ("", 0, False)]
    assert R.call_with_backoff(Narrow(), long, 1, 20000, 0) == [("", 0, False)]
    rows = spark.createDataFrame([("a", [("user", "bad")]), ("b", [("user", "good")])], "id string, messages array<struct<role:string,content:string>>")
    got = {(r["id"], r["sample_index"]): (r["response"], r["error"]) for r in R.generate(rows, Broken(), 2).collect()}
    assert got == {("a", 0): (None, "RuntimeError: no"), ("b", 0): ("fine", None), ("b", 1): ("fine", None)}


def test_retry(spark, tmp_path):
    rows = spark.createDataFrame([("b", [("user", "good")])], "id string, messages array<struct<role:string,content:string>>")
    out = R.with_retry(rows, Broken(), str(tmp_path)).first()
    assert (out["response"], out["retried_truncated"], out["initial_response"]) == ("fine", True, "fine")


def test_rounds(spark, tmp_path):
    questions = spark.createDataFrame([(i, f"question {i}") for i in range(25)], "id int, question string")
    config = R.RolloutConfig(samples=4, no_code_rounds=1, repair_rounds=1, adaptive_samples=2, seed=3)
    execute = R.programs(runner=printed)
    run = lambda: R.trajectories(questions, R.StubProvider(), str(tmp_path), config, execute=execute)
    one, two = run().collect(), run().collect()
    assert sorted(one) == sorted(two) and len(one) == 100
    assert {(r["id"], r["sample_index"]) for r in one} == {(i, k) for i in range(25) for k in range(4)}
    for r in one:
        if r["from_nocode_retry"]:
            assert "```" not in r["round1_text"] and "```" in r["latest_text"] or r["from_repair"]
        if r["status"] is None:
            assert "```" not in r["latest_text"]
    assert any(r["from_repair"] for r in one) and any(r["from_nocode_retry"] for r in one)
    samples = spark.createDataFrame(one)
    pool = {r["id"]: r for r in R.tool_pool(samples).collect()}
    assert len(pool) == 25 and all(r["n_samples"] == 4 for r in pool.values())
    more = R.adaptive(questions, samples, R.StubProvider(), str(tmp_path), config, execute=execute)
    assert more.filter("sample_index >= 4").count() % 2 == 0 and more.count() > 100
    assert sum(r["n"] for r in R.round_counters(samples).collect()) == 100


def test_zero_flag(spark):
    from dataclasses import replace

    assert replace(R.RolloutConfig(), zero_is_missing=True).zero_is_missing


def test_cli(spark, tmp_path, capsys):
    from argparse import Namespace

    from quillsieve import __main__ as cli

    rows = {"a": ("5", ["5", "5", "6"]), "b": ("7", ["1", "7", "2"]), "c": ("9", [None, "9", "9"])}
    paths = []
    for k in range(3):
        paths.append(str(tmp_path / f"v{k}.jsonl"))
        (tmp_path / f"v{k}.jsonl").write_text("".join(json.dumps({"id": i, "answer": g, "prediction": v[k], "response_tokens": 9, "retried_truncated": False}) + "\n" for i, (g, v) in rows.items()))
        (tmp_path / f"v{k}.csv").write_text("id,answer\n" + "".join(f"{i},{v[k] or 0}\n" for i, (g, v) in rows.items()))
    out = str(tmp_path / "out")
    cli.evaluate(Namespace(master="local[2]", inputs=paths, output=out, fallback_voter=2, abstain_truncated=False, stuck_threshold=2046))
    got = {r["id"]: (r["prediction"], r["decision"], r["correct"]) for r in spark.read.json(out).collect()}
    assert got == {"a": ("5", "majority", True), "b": ("7", "fallback", True), "c": ("9", "majority", True)}
    lines = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert [x["id"] for x in lines] == ["a", "b", "c"] and list(lines[2]) == ["id", "answer", "prediction", "correct", "votes", "raw_votes", "abstained_voters", "decision", "fallback_voter"]
    assert (lines[2]["raw_votes"], lines[2]["votes"], lines[2]["abstained_voters"], lines[2]["fallback_voter"]) == ([None, "9", "9"], [None, "9", "9"], [], 2)
    with open(paths[0], "a") as f:
        f.write(json.dumps({"id": "d", "answer": "1", "prediction": "1", "response_tokens": 2046, "retried_truncated": True}) + "\n")
    for path in paths[1:]:
        text = open(path).read()
        open(path, "w").write(json.dumps({"id": "d", "answer": "1", "prediction": "4", "response_tokens": 9, "retried_truncated": False}) + "\n" + text)
    cli.evaluate(Namespace(master="local[2]", inputs=paths, output=out + "2", fallback_voter=1, abstain_truncated=True, stuck_threshold=2046))
    last = [json.loads(r["value"]) for r in spark.read.text(out + "2").collect()][-1]
    assert (last["id"], last["votes"], last["raw_votes"], last["abstained_voters"], last["prediction"]) == ("d", [None, "4", "4"], ["1", "4", "4"], [1], "4")
    assert "order" in capsys.readouterr().err
    cli.submission(Namespace(master="local[2]", inputs=[p.replace("jsonl", "csv") for p in paths], output=str(tmp_path / "sub"), fallback_voter=1, expected_rows=3))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "sub")).collect()] == ["id,answer", "a,5", "b,1", "c,9"]


def test_cli_compose_and_merge(spark, tmp_path, capsys):
    """Each gate fires for one problem; missing pools are skipped, missing bands aren't."""
    from argparse import Namespace

    from quillsieve import __main__ as cli

    folder = tmp_path / "materials"
    folder.mkdir()

    def put(name, rows):
        (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    ids = ["plain", "sampled", "low", "middle", "moded", "pointed", "none"]
    for k in range(1, 6):
        put(f"voter_{k}.jsonl", [{"id": i, "prediction": None if i == "none" else "1", "response": "no"} for i in ids])
    values = {"support": {i: 4 if i in ("sampled", "moded") else 5 for i in ids}, "votes": {i: 2 if i == "low" else 5 if i == "middle" else 8 for i in ids}, "nrisky": {i: int(i == "middle") for i in ids}}
    (folder / "bands.json").write_text(json.dumps(values))
    put("samples.jsonl", [{"id": "sampled", "responses": ["Final answer: 22"] * 4 + ["Final answer: 1"] * 3}])
    put("tools_low.jsonl", [{"id": "low", "verified_counts": {"33": 1, "033.0": 1, "9": 1}}])
    put("tools_middle.jsonl", [{"id": "middle", "verified_counts": {"44": 2}}])
    put("screened.jsonl", [{"id": "moded", "predictions": ["55"] * 5 + ["1"]}, {"id": "plain", "predictions": ["7"] * 8}])
    put("pointer.jsonl", [{"id": "pointed", "prediction": "66"}])
    put("pointer_repeats.jsonl", [{"id": "pointed", "predictions": ["66", "66", "1"]}])
    put("pointer_pool_1.jsonl", [{"id": "pointed", "predictions": ["66"] * 3 + ["1"]}])
    put("pointer_pool_2.jsonl", [{"id": "pointed", "predictions": ["66", None]}])
    problems = tmp_path / "problems.csv"
    problems.write_text("id,question,answer\n" + "".join(f"{i},q,{'' if i == 'none' else 1}\n" for i in ids))
    args = Namespace(master="local[2]", input=str(problems), materials=str(folder), emit=[f"c2={tmp_path}/c2", f"c4={tmp_path}/c4"], names=None)
    cli.compose(args)
    read = lambda name: [r["value"] for r in spark.read.text(f"{tmp_path}/{name}").collect()]
    assert read("c4") == ["id,answer", "plain,1", "sampled,22", "low,33", "middle,44", "moded,55", "pointed,66", "none,0"]
    assert read("c2")[5:7] == ["moded,1", "pointed,1"] and "1 missing" in capsys.readouterr().out
    values["votes"].pop("low")
    (folder / "bands.json").write_text(json.dumps(values))
    with pytest.raises(CheckError, match="bands"):
        cli.compose(args)

    chat = [{"role": r, "content": "x"} for r in ("system", "user", "assistant")]
    for name, teacher in (("a", "t1"), ("b", "t2")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": name, "teacher": teacher, "messages": chat}) + "\n")
    args = Namespace(master="local[2]", inputs=[f"{tmp_path}/{n}.jsonl" for n in "ba"], output=f"{tmp_path}/merged", teacher_repeat=["t2=2"], max_length=50)
    cli.merge(args)
    assert [(r["id"], r["training_repeat"]) for r in map(json.loads, read("merged"))] == [("a", 1), ("b", 1), ("b", 2)]


def test_cli_rebuild(spark, tmp_path, capsys):
    """Extractors read the same texts differently; a golden submission shows where."""
    from argparse import Namespace

    from quillsieve import __main__ as cli

    put = lambda name, rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    for k in range(1, 6):
        put(f"voter_{k}.jsonl", [{"id": "a", "response": "\\boxed{1}\nFinal answer: 2"}, {"id": "b", "response": "Final answer: 5" if k < 3 else f"Final answer: 7{k}"}])
    put("samples.jsonl", [{"id": "a", "responses": ["Final answer: 8"] * 6}, {"id": "b", "responses": ["well 4", "Final answer: 4", "Final answer: 4"]}])
    put("tools_low.jsonl", [{"id": "b", "verified_counts": {"06": 5, "6": 1}}])
    put("tools_middle.jsonl", [{"id": "a", "verified_counts": {"9": 9}}])
    (tmp_path / "p.csv").write_text("id,question\na,q\nb,q\n")
    (tmp_path / "g.csv").write_text("id,answer\na,1\nb,5\n")
    said = {}
    for extractor in ("boxed_first", "final_first"):
        args = Namespace(master="local[2]", input=str(tmp_path / "p.csv"), materials=str(tmp_path), extractor=extractor, risky_bands="low", golden=[f"voters={tmp_path}/g.csv"], emit=[f"middle={tmp_path}/{extractor}"], names=None)
        cli.rebuild(args)
        said[extractor] = capsys.readouterr().out
    assert "voters: 0 answers differ" in said["boxed_first"] and "voters: 1 answers differ ['a']" in said["final_first"]
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/final_first").collect()] == ["id,answer", "a,2", "b,6"]


def test_slow_requests_hold_up_no_others(spark):
    """Every tenth request is slow; four in flight across batches of five rows, answers in the order of rows."""
    seen = []

    class Slow:
        def generate(self, messages, n, max_tokens, seed):
            k = int(messages[0]["content"])
            time.sleep(0.4 if k % 10 == 0 else 0.002)
            return [(f"said {k} {threading.active_count()}", 1, False)]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rows = spark.createDataFrame([(k, [("user", str(k))]) for k in range(100)], "id int, messages array<struct<role:string,content:string>>").coalesce(1)
    began = time.time()
    got = R.generate(rows, Slow(), workers=4, answers=30).collect()
    took = time.time() - began
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in got] == list(range(100)) and all(r["response"].startswith(f"said {r['id']} ") for r in got)
    assert took < 3.5  # ten slow ones: 4 s one after the other, about 1 s by four
    done = R.in_order(lambda k: seen.append(k) or k, iter(range(50)), 1, 3)
    assert next(done) == 0 and len(seen) <= 4 and list(done) == list(range(1, 50))


def test_rate_of_the_whole_job(spark):
    rows = spark.createDataFrame([(k, [("user", str(k))]) for k in range(12)], "id int, messages array<struct<role:string,content:string>>").coalesce(1)
    began = time.time()
    got = R.generate(rows, R.StubProvider(), workers=4, rate=10.0 * spark.sparkContext.defaultParallelism).collect()
    assert len(got) == 12 and time.time() - began >= 1.1


def test_cli_screen_pool_and_curate(spark, tmp_path):
    """A model server is asked for eight samples of each problem, what is done isn't asked again; a band of it becomes a
    pool; corpora become chosen rows with a manifest."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            k = int(body["messages"][-1]["content"].split()[-1])
            asked.append(k)
            said = [f"Final answer: {k if s < k else -1}" for s in range(body["n"])]
            self.send_response(500 if k == 7 and asked.count(7) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"index": s, "message": {"content": x}, "finish_reason": "length" if s == 0 else "stop"} for s, x in enumerate(said)], "usage": {"completion_tokens": 9}}).encode())

        def log_message(self, *_):
            pass

    def run(*args):
        import sys
        from unittest.mock import patch

        from quillsieve import __main__ as cli

        with patch.object(sys, "argv", ["quillsieve", "--master", "local[2]", *map(str, args)]):
            cli.main()

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    questions, out = tmp_path / "q.csv", tmp_path / "screened"
    questions.write_text("id,question,answer\n" + "".join(f" q{k},what is {k},\"{k}\"\n".replace(" q", "q") for k in range(1, 9)))
    for _ in range(2):
        run("screen", "--input", questions, "--output", out, "--model", "m", "--base-url", f"http://127.0.0.1:{server.server_port}/v1", "--resume", "--save-responses")
    server.shutdown()
    rows = {r["id"]: r for r in spark.read.json(str(out)).collect()}
    assert sorted(asked) == [1, 2, 3, 4, 5, 6, 7, 7, 8] and set(rows) == {f"q{k}" for k in range(1, 9)}
    assert all((r["n_correct"], r["num_samples"], r["pass_rate"], r["truncated"], r["answer"]) == (int(i[1:]), 8, int(i[1:]) / 8, 1, i[1:]) for i, r in rows.items())
    assert rows["q2"]["predictions"] == ["2", "2", *["-1"] * 6] and rows["q2"]["responses"][1] == "Final answer: 2"
    (tmp_path / "t.jsonl").write_text('{"id": "q3"}\n')
    run("pool", "--screen", out, "--pool-csv", questions, "--training", tmp_path / "t.jsonl", "--min-correct", 2, "--max-correct", 5, "--output", tmp_path / "pool")
    chosen = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "pool")).collect()]
    assert [(r["id"], r["answer"], r["screen_n_correct"]) for r in chosen] == [(f"q{k}", str(k), k) for k in (2, 4, 5)]
    assert [m["role"] for m in chosen[0]["prompt"]] == ["system", "user"] and chosen[0]["prompt"][1]["content"] == "what is 2"
    told = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "pool.manifest"), wholetext=True).collect()))
    assert told["screened"] == 8 and told["samples"] == 3 and told["training_skipped"] == 1 and told["band_histogram"]["4"] == 1
    corpus = [{"id": f"c{k}", "question": f"question number {k} about {'cats' if k % 2 else 'dogs'}", "solution": "x " * (70 if k != 4 else 3), "level": "hard" if k % 2 else "easy"} for k in range(20)]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(r) + "\n" for r in corpus))
    (tmp_path / "o.csv").write_text("id,question\no,Question number 6 about DOGS!\n")
    plan = {"sources": [{"name": "main", "path": str(tmp_path / "c.jsonl"), "quotas": {"hard": 3, "easy": 4}, "quota_key": "level", "reasons": [["odd", "id = 'c2'"]], "silent": "id = 'c1'"}]}
    run("curate", "--plan", json.dumps(plan), "--official", tmp_path / "o.csv", "--output", tmp_path / "curated", "--seed", 5, "--min-tokens", 64)
    kept = spark.read.json(str(tmp_path / "curated")).collect()
    assert len([r for r in kept if r["stratum"] == "hard"]) == 3 and {r["id"] for r in kept if r["stratum"] == "easy"} <= {f"c{k}" for k in range(0, 20, 2)} - {"c2", "c4", "c6"}
    told = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "curated.manifest"), wholetext=True).collect()))
    assert told["rejections"]["main_odd"] == 1 and told["rejections"]["solution_too_short"] == 1 and told["rejections"]["official_exact"] == 1
