"""What the findings of round 4 named."""

import json

import pytest
from pyspark.sql import functions as F

from quillsieve.functions import text
from quillsieve.llm import pii
from quillsieve.operators import nearness, votes
from quillsieve.plans import catalogue, compose
from quillsieve.plans.scratch import stored
from quillsieve.sources import jsondoc, sinks
from tests.test_round3 import by_sql


@pytest.mark.parametrize("lines", [1, 4097, 64**3 + 1])
def test_trees_of_long_files_have_the_height_of_the_sql(spark, tmp_path, lines):
    """One file of many lines, and a short one beside it."""
    keys = spark.range(lines).select((8 * F.col("id")).alias("o_orderkey")).union(spark.range(70).select(8 * F.col("id") + 1))
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    (tmp_path / "sql").mkdir()
    keys.toPandas().to_parquet(tmp_path / "sql" / "orders.parquet")
    wanted = by_sql("file_trees", tmp_path / "sql", "orders").sort_values("k").reset_index(drop=True)
    got = catalogue.queries()["file_trees"](spark, str(tmp_path)).toPandas().sort_values("k").reset_index(drop=True)
    assert got[list(wanted.columns)].values.tolist() == wanted.values.tolist()


def test_tables_counted_as_too_large_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 2)
    plans, kept = {}, pii.written

    def written(df, name, *args):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name, *args)

    monkeypatch.setattr(pii, "written", written)
    texts = [f"{name} writes from a{k % 3}.{name}@{name}.org on day {'x' * k}" for k in range(12) for name in ("anne", "bert", "carl")]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + ["others say " + "y" * k for k in range(200)])], "doc_id long, text string")
    docs = kept(docs, "docs")
    few = {tuple(r) for r in pii.find(docs).select("doc_id", "spans").collect()}
    assert plans["near-pairs"] and plans["term-pairs"]
    assert not any("Broadcast" in p for p in plans["near-pairs"] + plans["term-pairs"])
    terms = kept(spark.createDataFrame([(w,) for w in ("anne", "say", "day")], "term string"), "terms")
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("term"))
    met = pii._met(words, terms, "term", "doc_id", "left_semi")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 12 + 200 + 36
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 1000)
    assert few == {tuple(r) for r in pii.find(docs).select("doc_id", "spans").collect()}
    assert any("term" in spans for _, spans in few)


def test_answers_of_pools_are_made_once(spark):
    rows = [(1, "a", " 05.0"), (1, "b", "5"), (2, "a", None), (2, "b", "no"), (3, "a", "-0"), (3, "a", "x")]
    counts = spark.createDataFrame(rows, "id int, pool string, said string").select("id", "pool", text.canonical(F.col("said")).alias("answer"), F.lit(1).cast("bigint").alias("n"))
    per = votes.pooled_tops(counts, ("a", "b"), ("b",))
    plan = per._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "RLIKE" in line for line in plan.splitlines())
    assert {r["id"]: (r["a"] and r["a"]["top"], r["b"] and r["b"]["top"], r["b_map"]) for r in per.collect()} == {1: ("5", "5", {"5": 1}), 3: ("0", None, None)}


def test_plain_answers_are_what_they_were(spark):
    said = ["0", "-0", "00", "7", "-7", "+7", "07", "7\n", " 7", "7.0", "1,000", "-12", "9" * 40, "", "x", None, "1_0", "٣", "5e2"]
    made = spark.createDataFrame([(s,) for s in said], "s string").select(text.canonical(F.col("s")).alias("c"), text.canonical_output(F.col("s")).alias("o")).collect()
    want = ["0", "0", "0", "7", "-7", "7", "7", "7", "7", "7", "1000", "-12", "9" * 40, None, None, None, "10", None, "500"]
    assert [r["c"] for r in made] == want
    assert [r["o"] for r in made] == [None if s == "1,000" else w for s, w in zip(said, want)]


def test_bands_are_read_once_for_their_parts(spark, tmp_path):
    maps = {"support": {"1": 3, 'q" \\ ,{': 4, "": 0}, "votes": {"1": -2, "7,7": 5, "n": 10**17}, "nrisky": {"1": 0, "z": None}}
    (tmp_path / "bands.json").write_text(json.dumps(maps, indent=1))
    got = {r["id"]: r[1:] for r in compose.read_bands(spark, str(tmp_path / "bands.json")).collect()}
    assert got == {i: tuple(maps[m].get(i) for m in compose.BANDS) for m in maps for i in maps[m]}
    kept = []

    def keep(df):
        kept.append(df.columns)
        return stored(df)

    found = jsondoc.elements(spark, str(tmp_path / "bands.json"), 2, keep)
    assert len(kept) == 1 and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 8


def test_the_emitted_submission_is_written_by_many(spark, small, monkeypatch):
    seen, kept = [], sinks.write_submission

    def write(df, path, ord_col="ord", one_file=True):
        seen.append(one_file)
        return kept(df, path, ord_col, one_file)

    monkeypatch.setattr(sinks, "write_submission", write)
    got = catalogue.queries()["composed_submission"](spark, small).toPandas().sort_values("id").values.tolist()
    assert seen == [False]
    assert got == by_sql("composed_submission", small, "lineitem").sort_values("id").values.tolist()


def test_near_texts_of_a_family_move_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(nearness, "BLOCK", 4)
    base = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    family = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(30)]
    rows = [(k, t) for k, t in enumerate(family)] + [(100 + k, t + " more") for k, t in enumerate(family[:3])] + [(3, family[3]), (3, "an own text of seven words here"), (200, "an own text of seven words here so")]
    rows += [(300, "a b c d"), (301, "d c b a"), (302, "one two three four five six seven"), (303, "one two three four five six seven eight")]
    kept = nearness._token_near

    def spied(*options):
        run = kept(*options)

        def counted(batches):
            def named():
                for batch in batches:
                    seen.add(sum(x is not None for x in batch.column("norm").to_pylist()))
                    yield batch

            return run(named())

        return counted

    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(nearness, "_token_near", spied)
    got = {tuple(r)[:4] for r in nearness.near_copies(spark.createDataFrame(rows, "id int, text string"), store=stored).collect()}
    want = set()
    for a, x in rows:
        for b, y in rows:
            s, t = x.split(), y.split()
            j, r = len({*s} & {*t}) / len({*s} | {*t}), min(len(s), len(t)) / max(len(s), len(t))
            g, h = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (s, t))
            if a < b and j >= 0.85 and r >= 0.8 and g & h:
                want.add((a, b, j, r))
    assert len(want) > 400 and got == want
    assert 0 < seen.value < len(want)  # texts that moved
