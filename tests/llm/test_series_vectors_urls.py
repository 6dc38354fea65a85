"""Resampling, whitening and URL templates against plain Python."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsieve.llm import queries, resample, urltree, whitening
from quillsieve.llm.common import fresh_path

from .conftest import same

CLICKS = "click_id long, ts timestamp_ntz, client_id long, value double, bin string, p string, key string"
EPOCH = datetime(1970, 1, 1)


def plain_buckets(rows, signal, ahead, cap=3600, width=3600):
    """Second by second is too slow for long gaps; pieces with exact fractions instead."""
    last = {}
    for click, ts, client, value, *_ in rows:
        if client is None or ts is None or value is None or not math.isfinite(value) or abs(value) * 100 > resample.most_cents(cap, width) - 1:
            continue
        sec = (ts - EPOCH) // timedelta(seconds=1)
        rank = (click is not None, click or 0, math.floor(100 * value + 0.5))
        last[client, sec] = max(last.get((client, sec), rank), rank)
    series = defaultdict(list)
    for (client, sec), rank in sorted(last.items()):
        series[client].append((sec, rank[2]))
    out = defaultdict(lambda: [0, 0, 0])
    for client, pts in series.items():
        for k, (sec, v) in enumerate(pts):
            out[client, sec - (sec + ahead) % width][0] += 1
            near = k + 1 < len(pts) and pts[k + 1][0] - sec <= cap
            d = pts[k + 1][0] - sec if near else cap if signal == "step" else 0
            w = pts[k + 1][1] if near and signal == "linear" else v

            def area(u):
                return 2 * v * u + math.floor(Fraction((w - v) * u * u, d))

            start = sec - (sec + ahead) % width
            while d and start < sec + d:
                a, b = max(0, start - sec), min(d, start + width - sec)
                out[client, start][1] += b - a
                out[client, start][2] += area(b) - area(a)
                start += width
    return [(c, b, n, s, a, a // (2 * s) if s else None) for (c, b), (n, s, a) in out.items()]


def odd_clicks():
    rng = random.Random(11)
    rows, at = [], datetime(2024, 1, 1, 23, 10)
    for k in range(400):
        at += timedelta(seconds=rng.choice([0, 0.4, 1, 7, 60, 900, 3599, 3600, 3601, 9000]))
        rows.append((k, at, rng.choice([1, 1, 1, 2, 3]), rng.choice([5.005, -3.335, 0.0, 77.7, -0.001, 1e6, 1e12])))
    for s in range(1300):  # a dense stretch of one client
        rows.append((5000 + s, datetime(2024, 3, 1) + timedelta(seconds=s * 2), 9, float(s % 17) - 8))
    rows += [rows[3], rows[3], (None, at, 1, 4.0), (2, at, 1, 9.0), (2, at, 1, 8.0), (7, None, 1, 1.0), (8, at, None, 1.0), (9, at, 2, None), (10, at, 2, math.nan), (11, at, 2, math.inf), (12, at, 2, 1e300)]
    rows += [(20, datetime(1969, 12, 31, 23, 59, 58, 500000), 4, 2.0), (21, datetime(1970, 1, 1, 0, 40, 0, 1), 4, -2.0), (22, datetime(2024, 5, 5), 5, -9e12), (23, datetime(2024, 5, 5, 0, 59, 59), 5, 9e12)]
    return [(*r, "clash", "clash", "clash") for r in rows]


@pytest.mark.parametrize("signal", ["step", "linear"])
@pytest.mark.parametrize(("zone", "ahead"), [("Asia/Kolkata", 19800), ("UTC", 0)])
def test_buckets(spark, signal, zone, ahead):
    rows = odd_clicks()
    found = resample.digests(spark.createDataFrame(rows, CLICKS).repartition(3), zone, signal)
    assert found.columns == ["client_id", "bucket_start", "n_points", "covered_seconds", "area2", "avg_cents"]
    assert {kind for _, kind in found.dtypes} == {"bigint"}
    same(found.collect(), plain_buckets(rows, signal, ahead))
    assert resample.digests(spark.createDataFrame(rows, CLICKS).limit(0), zone, signal).count() == 0


def test_buckets_other_widths(spark):
    """Times with a zone, text keys, a cap that isn't the bucket's width."""
    rows = odd_clicks()
    moments = [(r[0], r[1] and r[1].replace(tzinfo=timezone.utc), r[2], r[3]) for r in rows]
    df = spark.createDataFrame(moments, "click_id long, ts timestamp, client_id long, value double").withColumn("client_id", F.col("client_id").cast("string"))
    pts = resample.points(df, limit=resample.most_cents(600, 86400))
    found = resample.resample(pts, "step", "UTC", width=86400, cap=600)
    same([(int(r[0]), *r[1:]) for r in found.collect()], plain_buckets(rows, "step", 0, 600, 86400))


def test_successors_make_no_pairs(spark):
    """A dense client makes one row a point; nothing is broadcast and no window is left."""
    df = spark.createDataFrame(odd_clicks(), CLICKS)
    pts = resample.points(df)
    chain = resample.successors(pts)
    assert chain.count() == pts.count()
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_buckets_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clicks AS SELECT * FROM '{small}/clicks.parquet'")
    found = queries.op11_resample(spark, small)
    columns = ", ".join(found.columns)
    same(found.collect(), con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()['op11_resample']})").fetchall())


VECTORS = "vec_id long, embedding array<float>, deviation string, x string, part int, high double"


def odd_vectors():
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 10)) * [3, 2.5, 2, 1.7, 1.4, 1.2, 1, 0.8, 0.6, 0.4] @ np.linalg.qr(rng.normal(size=(10, 10)))[0]
    rows = [(k if k % 40 else None, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [rows[5], rows[5], rows[6], (900, None), (901, []), (902, [1.0] * 9 + [None]), (903, [math.nan] + [1.0] * 9), (904, [math.inf] + [0.0] * 9), (905, [0.5] * 7)]
    return [(*r, "clash", "clash", 1, 2.0) for r in rows]


def plain_whitening(rows, d, k):
    vectors = [(r[0], r[1]) for r in rows if r[1] and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    v = np.array([[float(Fraction(sum(row[i] * row[j] for row in y), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    w = np.array(y, float) / n @ axes[:, :k] / np.sqrt(values[:k])
    return n, [(i, sum(c * c for c in row)) for (i, _), row in zip(vectors, y, strict=True)], w, values / values.sum()


def test_whitening(spark):
    rows = odd_vectors()
    found = whitening.digests(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got, (n, deviations, w, explained) = found.collect(), plain_whitening(rows, 10, 8)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    for c in range(8):
        mine = [(r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1]
        same([m[:2] for m in mine], [(-1 if i is None else i, e) for i, e in deviations])
        sign = {i: x for i, _, x in mine}
        flip = math.copysign(1, sign[7] * next(x for (i, _), x in zip(deviations, w[:, c], strict=True) if i == 7))
        theirs = sorted((-1 if i is None else i, e, flip * x) for (i, e), x in zip(deviations, w[:, c], strict=True))
        assert np.allclose([m[2] for m in sorted(mine)], [t[2] for t in theirs], atol=1e-9)
        assert [*{r["explained"] for r in got if r["component"] == c + 1}] == [pytest.approx(explained[c], rel=1e-12)]
    assert [*{r["identity_error"] for r in got}] == [pytest.approx(0, abs=1e-10)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 4.0])]])
def test_whitening_of_few_rows(spark, rows):
    """Without variance the coordinates are null; two rows have one component with it."""
    found = whitening.digests(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    usable = sum(v is not None for _, v in rows)
    assert len(found) == 2 * usable
    assert [r["whitened"] is not None for r in sorted(found, key=lambda r: r["component"])] == ([True] * 2 if usable == 2 else [False] * usable) + [False] * usable
    assert all(r["identity_error"] is None for r in found)


def test_compensated_sums(spark):
    """Entries of 1e8 with deviations of 1e-6: plain sums of squares lose the variance, pairs of doubles don't."""
    rng = np.random.default_rng(3)
    x = 1e8 + rng.integers(-50, 50, size=(2000, 3)) / 2.0**20
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(7)
    n, _, mean, (v, _) = whitening.covariance(df, "v", 3)
    exact = [[Fraction(c) for c in row] for row in x.tolist()]
    means = [sum(c) / n for c in zip(*exact, strict=True)]
    for i in range(3):
        assert Fraction(mean[0][i]) + Fraction(mean[1][i]) == pytest.approx(means[i], rel=1e-30)
        for j in range(3):
            want = float(sum((r[i] - means[i]) * (r[j] - means[j]) for r in exact) / n)
            assert v[i, j] == pytest.approx(want, rel=1e-12, abs=1e-24)


def test_error_free(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-9, 9, 500), rng.normal(size=500) * 10.0 ** rng.integers(-9, 9, 500)
    for exact, (high, low) in ((lambda x, y: x + y, whitening.two_sum(a, b)), (lambda x, y: x * y, whitening.two_product(a, b))):
        assert all(Fraction(h) + Fraction(w) == exact(Fraction(x), Fraction(y)) for h, w, x, y in zip(high, low, a, b, strict=True))


RULES = queries.URL_RULES


def plain_place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, rest = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def odd_urls():
    rng = random.Random(13)
    urls = [None, "", "no scheme/at/all", "http://", "http://EXAMPLE.com", "https://Example.COM/en/", "http://www.example.com/en/1?a=/x#y", "http://example.com/en", "ftp://a.b://c/d", "http://com/x", "http://xcom/x", "http://notexample.com/en/1", "http://a.net/es/1#q", "http://a.net?es/", "http://ÉX.net/fr/\n2", "http://h.org/" + "a/" * 60, "http://h.org//", "http://h.org/*/**"]
    for _ in range(600):
        section = rng.choice(["news", "shop", "spam", "spam", "forum"])
        urls.append(f"http://big.org/{section}/{rng.randint(1, 10**6)}" + ("/page/2" if section == "forum" else ""))
    return urls + [urls[-1]] * 3


def test_url_verdicts(spark):
    """Rules as written; templates of one section are bad by their labels, those of the others are not."""
    rng = random.Random(5)
    rows = [(k, u, None if u is None or "big.org" not in u or rng.random() < 0.5 else int("/spam/" in u and rng.random() < 0.95), "clash", "clash") for k, u in enumerate(odd_urls())]
    df = spark.createDataFrame(rows, "page_id long, url string, label int, template string, rest string").repartition(3)
    found = {r["page_id"]: r for r in urltree.judge(df, RULES, bad=F.col("label")).collect()}
    assert len(found) == len(rows)
    for k, url, *_ in rows:
        host, path = plain_place(url)
        rule = plain_rule(host, path, RULES)
        want = rule[0] if rule else "block" if "/spam/" in (url or "") else "allow"
        assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == (host, path, rule and rule[1], want), url
    named = {found[k]["template"] for k, u, *_ in rows if u and "big.org" in u}
    assert named == {"/(news|shop)/*", "/spam/*", "/forum/*/page/2"}
    assert found[next(k for k, u, *_ in rows if u and u.endswith("a/" * 60))]["template"] == "/*" * 12 + "/**"
    empty = urltree.judge(df.limit(0), RULES, bad=F.col("label"))
    assert empty.count() == 0


def plain_templates(rows, min_share, min_urls, z):
    """The tree of one host by recursion over lists."""

    def grow(rows, level, template):
        out, groups = {}, defaultdict(list)
        for r in rows:
            if len(r[1]) <= level:
                out[r[0]] = template
            else:
                groups[r[1][level]].append(r)
        total = sum(map(len, groups.values()))
        literal = {s: g for s, g in groups.items() if len(g) >= min_urls and len(g) >= min_share * total}
        stats = []
        for s, g in literal.items():
            marks = [r[2] for r in g if r[2] is not None]
            profile = [sum(min(len(r[1]) - level - 1, 3) == k for r in g) for k in range(4)]
            stats.append((s, len(g), len(marks), sum(marks), profile))
        names = dict(zip([x[0] for x in stats], urltree.merge_branches(stats, z), strict=True))
        merged = defaultdict(list)
        for s, g in groups.items():
            merged[names.get(s, "*")] += g
        for name, g in merged.items():
            out |= grow(g, level + 1, f"{template}/{name}")
        return out

    return grow(rows, 0, "")


@pytest.mark.parametrize(("min_share", "min_urls"), [(0.01, 20), (0.2, 1), (0.0, 1)])
def test_templates_against_recursion(spark, min_share, min_urls):
    rng = random.Random(17)
    rows = []
    for k in range(900):
        host = rng.choice(["a", "a", "b", "c"])
        segments = [rng.choice("pqrs") * rng.randint(1, 2) for _ in range(rng.randint(0, 4))]
        rows.append((k, host, segments, rng.choice([None, 0, int("qq" in segments)])))
    df = spark.createDataFrame([(k, h, "/" + "/".join(s), b) for k, h, s, b in rows], "k long, host string, path string, bad int").repartition(3)
    found = urltree.templates(df, min_share=min_share, min_urls=min_urls)
    want = {}
    for host in "abc":
        want |= plain_templates([(k, s, b) for k, h, s, b in rows if h == host], min_share, min_urls, 2.0)
    same([(r["k"], r["template"]) for r in found.collect()], want.items())
    sums = defaultdict(lambda: [0, 0, 0])
    for k, h, _, b in rows:
        for j, x in enumerate((1, b is not None, b or 0)):
            sums[h, want[k]][j] += x
    base = sum(s[2] for s in sums.values()) / sum(s[1] for s in sums.values())
    got = urltree.purities(found, 10.0).collect()
    assert {(r["host"], r["template"]): (r["urls"], r["labelled"], round(r["purity"], 12)) for r in got} == {k: (n, m, round(1 - (b + 10 * base) / (m + 10), 12)) for k, (n, m, b) in sums.items()}


def test_rules_of_any_number(spark):
    """A list as long as the hosts, with ties of suffixes."""
    rng = random.Random(19)
    hosts = [".".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rules = sorted({(rng.choice(["allow", "block"]), h + "/" + rng.choice(["", "x", "x/y/"])) for h in hosts[:120]}, key=lambda r: r[1])
    rules = list({r[1]: r for r in rules}.values())
    rows = [(k, f"http://{h}/{rng.choice(['', 'x', 'xz', 'x/y/1'])}") for k, h in enumerate(hosts)]
    found = urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), rules)
    want = []
    for k, url in rows:
        host, path = plain_place(url)
        rule = plain_rule(host, path, rules)
        want.append((k, host, path, rule and rule[1], rule[0] if rule else "allow"))
    same(found.select("page_id", "host", "path", "rule", "verdict").collect(), want)


def test_url_query(spark, small):
    """Every page once, in the order of the contract's columns; files can be written."""
    found = queries.op13_url_tree(spark, small)
    path = fresh_path(spark, "urls")
    found.write.parquet(path)
    rows = spark.read.parquet(path).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r["page_id"] for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        host, path = plain_place(pages[r["page_id"]])
        rule = plain_rule(host, path, RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1]) and r["verdict"] == (rule[0] if rule else r["verdict"])
