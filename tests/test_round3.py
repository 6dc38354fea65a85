"""What the findings of round 3 named."""

import random
import re

import duckdb
import pytest

from quillsieve.operators import checks, nearness
from quillsieve.operators import votes as V
from quillsieve.plans import catalogue, curate, roundtrips


@pytest.fixture
def plain_json(spark):
    """Spark's own default, whatever the session was made with."""
    key = "spark.sql.jsonGenerator.ignoreNullFields"
    kept = spark.conf.get(key)
    spark.conf.set(key, "true")
    yield
    spark.conf.set(key, kept)


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(catalogue.oracle_sql()[name]).df()


def test_lines_have_their_nulls_in_any_session(spark, small, plain_json):
    wanted = by_sql("file_trees", small, "orders").sort_values("k").reset_index(drop=True)
    got = catalogue.queries()["file_trees"](spark, small).toPandas().sort_values("k").reset_index(drop=True)
    assert got[list(wanted.columns)].values.tolist() == wanted.values.tolist()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_wide_state_of_an_id_does_not_move(spark):
    rows = [(1, "a", "5", 2), (1, "a", "7", 2), (1, "b", "5", 1), (1, "b", "5", 4), (2, "b", "9", 1), (2, "a", None, 8), (2, "c", "9", 3)]
    counts = spark.createDataFrame(rows, "id int, pool string, answer string, n long").repartition(3)
    per = V.pooled_tops(counts, ("a", "b"), ("b",))
    moved = [line for line in plan_of(per).splitlines() if "Exchange hashpartitioning(id" in line]
    assert len(moved) == 2 and sum("REPARTITION_BY_COL" in line for line in moved) == 1  # sums by answer, then the same rows to their ids
    got = {r["id"]: r.asDict(True) for r in per.collect()}
    assert got[1] == {"id": 1, "a": {"top": "7", "support": 2, "ties": True, "total": 4}, "b": {"top": "5", "support": 5, "ties": False, "total": 5}, "b_map": {"5": 5}}
    assert got[2] == {"id": 2, "a": None, "b": {"top": "9", "support": 1, "ties": False, "total": 1}, "b_map": {"9": 1}}


@pytest.fixture
def scans(monkeypatch):
    """How often lineitem is written to a file or table from the driver's own table, by the plans of what is written."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen = []

    def spied(kind):
        kept = getattr(DataFrameWriter, kind)

        def write(self, *args, **named):
            seen.append(plan_of(self._df).count("lineitem.parquet"))
            return kept(self, *args, **named)

        monkeypatch.setattr(DataFrameWriter, kind, write)

    for kind in ("json", "parquet", "text"):
        spied(kind)
    return seen


@pytest.mark.parametrize("make", ["materials", "_raw"])
def test_materials_read_the_lines_twice(spark, small, scans, make):
    getattr(roundtrips, make)(spark, small)
    assert sum(scans) == 2  # once for the voters, once for everything else


def test_exact_texts_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearness, "shingle_pairs", None)
    rows = spark.createDataFrame([(1, "Some words here."), (2, "some WORDS here"), (3, " "), (4, None), (5, "some words there")], "id long, text string")
    official = spark.createDataFrame([("some words, here",)], "text string")
    got = nearness.contamination(rows, official, near=False).collect()
    assert sorted(map(tuple, got)) == [(1, "exact"), (2, "exact"), (3, "empty"), (4, "empty")]


def test_id_differences_are_one_aggregate(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "id int") for ids in ([1, 1, 2, None], [2, 3, 3, None]))
    found = checks.id_differences(a, b)
    assert "Join" not in plan_of(found)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "missing"), (None, "missing"), (3, "extra"), (None, "extra")], key=repr)


def test_near_copies_move_no_text_that_has_no_pair(spark):
    rng = random.Random(3)
    base = [[f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}" for _ in range(rng.randint(1, 60))] for _ in range(40)]
    texts = [" ".join(t) for t in base + [[w if rng.random() > 0.05 else "zz" for w in b] for b in base * 2]] + ["", None, "lone"] + [" ".join(base[0]).upper()] * 3
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0])]
    kept = []

    def keep(df):
        kept.append(df)
        return df

    got = nearness.near_copies(spark.createDataFrame(rows, "id int, text string"), store=keep)
    first = {}
    for k, t in enumerate(texts):
        words = tuple(re.findall(r"[a-z]+|\d+", (t or "").lower()))
        if words:
            first.setdefault(words, k)
    grams = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in first}
    want = set()
    for x, a in first.items():
        for y, b in first.items():
            j, r = len(set(x) & set(y)) / len(set(x) | set(y)), min(len(x), len(y)) / max(len(x), len(y))
            if a < b and j >= 0.85 and r >= 0.8 and grams[x] & grams[y]:
                want.add((a, b, j, r, "near_token"))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    paired = {k for p in kept if p.columns == ["left_id", "right_id"] for r in p.collect() for k in r}
    held = [df for df in kept if any(kind == "array<string>" or name == "norm" for name, kind in df.dtypes)]
    assert len(held) == 1 and {r["id"] for r in held[0].select("id").collect()} == paired


def test_near_documents_are_not_written_as_tokens(spark, small, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    written, kept = [], DataFrameWriter.parquet

    def parquet(self, *args, **named):
        written.append([kind for _, kind in self._df.dtypes])
        return kept(self, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    catalogue.queries()["near_dup_documents"](spark, small).count()
    assert written and not any("array<string>" in kinds for kinds in written)


def test_texts_of_other_lengths_are_not_kept(spark):
    item = "one two three four five six seven eight nine ten"
    official = spark.createDataFrame([(1, item), (2, None), (3, "")], "id int, text string")
    longer, shorter = item + " more and", " ".join(item.split()[:8])
    rows = [(1, item), (2, longer), (3, shorter), (4, item + " so"), (5, " ".join([item] * 30)), (6, "one two"), (7, None), (8, item.upper())]
    kept = []

    def keep(df):
        kept.append(df)
        return df

    got = nearness.contamination(spark.createDataFrame(rows, "id int, text string"), official, store=keep).collect()
    assert sorted(map(tuple, got)) == [(1, "exact"), (4, "near_token"), (7, "empty"), (8, "exact")]
    sizes = {len(r["tokens"]) for df in kept if "tokens" in df.columns for r in df.collect()}
    assert sizes == {0, 8, 10, 11, 12}
    nothing = nearness.contamination(spark.createDataFrame(rows, "id int, text string"), official.filter("id > 1")).collect()
    assert [tuple(r) for r in nothing] == [(7, "empty")]


def test_lengths_are_bounded_on_both_sides(spark):
    rows = spark.createDataFrame([(n, ["w"] * n) for n in range(20)], "id int, tokens array<string>")
    others = spark.createDataFrame([(1, ["v"] * 5), (2, ["v"] * 10), (3, []), (4, None)], "id int, tokens array<string>")
    assert sorted(r["id"] for r in nearness.alike_in_length(rows, others).collect()) == list(range(4, 13))


def test_long_questions_are_judged_without_their_tokens(spark, monkeypatch):
    kept, store = [], curate.stored

    def keep(df):
        kept.append(store(df))
        return kept[-1]

    monkeypatch.setattr(curate, "stored", keep)
    item = "one two three four five six seven eight nine ten"
    texts = [item, item + " more", "word " * 200, "word " * 200, "", None, "see http://x.y"]
    rows = spark.createDataFrame([(k, k, t, "a b c", "en") for k, t in enumerate(texts)], "ord int, id int, question string, solution string, lang string")
    official = spark.createDataFrame([(item,)], "text string")
    judged = curate.judge([curate.Source("main", rows, {"en": 1}, "lang")], official, limits=curate.Limits(1, 9, 9), sequences=False)
    assert {r["id"]: r["rejection"] for r in judged.collect()} == {0: "official_exact", 1: "official_near_token", 2: None, 3: "external_duplicate", 4: "official_empty", 5: "official_empty", 6: "visual_or_url"}
    assert [r["norm"] for r in judged.filter("id = 5").collect()] == [None]
    sizes = {len(r["tokens"]) for df in kept if "tokens" in df.columns for r in df.collect()}
    assert sizes == {0, 10, 11}
