"""Operators on tables against plain Python: shards, fingerprints of neighbours, WARC, mixing, classifier, pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillsieve.llm import editprints, mixing, qualityfm, sharding, warc
from quillsieve.llm.common import fresh_path

from .conftest import SCHEMA, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [1, 4, 24])
def test_shards_odd(odd, odd_rows, none, n):
    found = sharding.assign(odd, n).collect()
    size = lambda t: len((t or "").encode()) + 8
    same([(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in found], [(r[0], size(r[1]), zlib.crc32((r[1] or "").encode()), "bytes", None) for r in odd_rows])
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < n and sorted(v) == list(range(len(v))) for s, v in slots.items())
    assert sharding.assign(none, n).count() == 0


def test_shards_even(spark):
    """Bytes come equal within the tolerance although one text has a third of them; copies are cut at borders only."""
    rows = [(k, "hot " * 100) for k in range(400)] + [(1000 + k, f"text {k // 2} " * (20 + k % 30)) for k in range(1200)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    per, groups = Counter(), defaultdict(set)
    for r in found:
        per[r["shard"]] += r["size"]
        groups[r["text_crc32"]].add(r["shard"])
    mean, largest = sum(per.values()) / 8, max(len(t) + 8 for _, t in rows)
    assert all(abs(v - mean) <= 2 * max(0.005 * mean, largest / 2) for v in per.values())  # two borders each
    assert sum(len(s) > 1 for s in groups.values()) <= 7
    assert all(max(s) - min(s) == len(s) - 1 for s in groups.values())
    again = sharding.assign(spark.createDataFrame(rows[::-1], "doc_id long, text string"), 8).collect()
    same([tuple(r) for r in found], [tuple(r) for r in again])


def test_shard_files(odd, odd_rows, spark):
    """All columns come back as they were; a user's `shard` under another name."""
    path = fresh_path(spark, "shards")
    sharding.write_shards(odd, path, 3)
    back = spark.read.parquet(path)
    names = [c for c in odd.columns if c != "shard"]
    same(back.select(*names).collect(), odd.select(*names).collect())
    assert {r["shard_"] for r in back.collect()} == {"clash-shard"} and {r["shard"] for r in back.collect()} <= {0, 1, 2}


def test_splitters_against_a_sort(spark):
    """Each border is the key whose bytes below come nearest to the wanted ones, up to the tolerance, as in a full sort."""
    docs = spark.createDataFrame([(k, f"text {k} " * (1 + k * 7 % 40)) for k in range(900)], "doc_id long, text string")
    keys = sharding.keyed(docs).select("size", "_k1", "_k2")
    rows = sorted((r["_k1"], r["_k2"], r["size"]) for r in keys.collect())
    total, n = sum(r[2] for r in rows), 7
    for i, border in enumerate(sharding.splitters(keys, n, tolerance=0.001)):
        below = sum(s for a, b, s in rows if (a, b) < border)
        want, sums = total * (i + 1) // n, [0]
        for r in rows:
            sums.append(sums[-1] + r[2])
        assert below in sums and abs(below - want) <= max(min(abs(x - want) for x in sums), 0.001 * total / n, max(r[2] for r in rows))


def plain_walk(text):
    """One step at a time, by the definition."""
    classes, bits, place, written = editprints._classes(text).tolist(), editprints._bits(), 0, []
    while classes[place] or not written:
        written.append(int(editprints._digits()[classes[place]]))
        place += int(bits[len(written) - 1 & 4095, classes[place]])
        if not classes[place]:
            break
    out, k = [], 0
    while True:
        steps = editprints._octave(k)[0]
        out += [written[s] if s < len(written) else 0 for s in steps]
        k += 1
        if editprints.PER_OCTAVE << k >= 2 * len(written) + 64:
            break
    last = max((i for i, d in enumerate(out) if d), default=0)
    return "".join(f"{d:x}" for d in out[: (last // editprints.PER_OCTAVE + 1) * editprints.PER_OCTAVE])


def test_walk():
    rng = np.random.default_rng(1)
    texts = ["", "a", "abc", "é" * 70] + ["".join(rng.choice(list("abcdef é\n"), rng.integers(1, 900))) for _ in range(20)]
    expected = [plain_walk(t) for t in texts]
    assert [editprints.fingerprint_text(s) for s in editprints.walk(texts)] == expected
    assert [editprints.fingerprint_text(editprints.walk([t])[0]) for t in texts] == expected
    long = "".join(rng.choice(list("abcdefghij "), 4000))
    a, b, c = editprints.walk([long, long[:2000] + "x" + long[2000:], "".join(rng.choice(list("abcdefghij "), 4000))])
    assert editprints.likeness(a, a) == 1 and editprints.likeness(a, b) > 0.6 > 0.4 > editprints.likeness(a, c)


def test_next_odd(odd, odd_rows, none):
    def place(text):
        n = xxhash.xxh64_intdigest((text or "").encode(), 42)
        return n - (1 << 64) if n >> 63 else n

    rows = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0, place(r[1])))
    expected = []
    for k, r in enumerate(rows):
        text, after = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        change = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = editprints.walk([text, change, after])
        spell = editprints.fingerprint_text
        expected.append((r[0], len(text), hashlib.sha256(change.encode()).hexdigest(), spell(a), spell(b), editprints.likeness(a, b), editprints.likeness(a, c)))
    same(editprints.compare_with_next(odd).collect(), expected)
    assert editprints.compare_with_next(none).count() == 0
    assert editprints.compare_with_next(odd.filter("doc_id = 3").limit(1)).first()["near_next"] == 1.0


def test_near_pairs(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefghij "), 2000)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t[:1800] + "!" + t[1800:]) for k, t in enumerate(base)]
    found = {k: editprints.fingerprint_text(editprints.walk([t])[0]) for k, t in rows}
    pairs = {(r["a"], r["b"]) for r in editprints.near_pairs(spark.createDataFrame(list(found.items()), "doc_id long, fingerprint string"), 0.7).collect()}
    assert {(k, 100 + k) for k in range(20) if found[k] != found[100 + k]} == pairs  # equal fingerprints are one node


@pytest.mark.parametrize("small", [32, 4])
def test_near_pairs_of_mixed_bands(spark, small):
    """Texts that share their first part and differ in the rest head the bands of families they aren't part of."""
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    opening, rows = say(1100), []
    for family in range(4):
        rest = say(900)
        rows += [(family, opening + say(900)), *[(100 + 10 * family + k, opening + rest[: 850 - 9 * k] + "!" + rest[850 - 9 * k :]) for k in range(3)]]
    prints = [(k, editprints.fingerprint_text(editprints.walk([t])[0])) for k, t in rows]
    back = bytes.maketrans(b"0123456789abcdef", bytes(range(16)))
    raw = {k: p.encode().translate(back) for k, p in prints}

    def groups(pairs):
        top = {k: k for k in raw}
        for a, b in pairs:
            x, y = top[a], top[b]
            top = {k: min(x, y) if t in (x, y) else t for k, t in top.items()}
        return top

    table = spark.createDataFrame(prints, "doc_id long, fingerprint string")
    found = editprints.near_pairs(table, small=small).collect()
    assert all(r["likeness"] == editprints.likeness(raw[r["a"]], raw[r["b"]]) >= 0.8 for r in found)
    first = {p: min(k for k, q in prints if q == p) for _, p in prints}
    copies = [(first[p], k) for k, p in prints if first[p] != k]  # equal fingerprints are one node
    expected = groups([(a, b) for a in raw for b in raw if a < b and editprints.likeness(raw[a], raw[b]) >= 0.8])
    assert groups([(r["a"], r["b"]) for r in found] + copies) == expected
    assert {r["doc_id"]: r["near_id"] for r in editprints.near_groups(table, small=small).collect()} == expected
    assert len(set(expected.values())) > 4 and copies != [(a, b) for a, b in expected.items() if a != b]


def test_near_groups_odd(odd, odd_rows, none):
    """Every row comes back, null ids too; equal fingerprints share a group, known by its smallest id."""
    prints = editprints.compare_with_next(odd)
    found = editprints.near_groups(prints).collect()
    same([r[:-2] for r in found], prints.collect())
    by = defaultdict(set)
    for r in found:
        by[r["fingerprint"]].add((r["near_id"], r["n_near"]))
        assert r["near_id"] is None or r["doc_id"] is None or r["near_id"] <= r["doc_id"]
    assert all(len(groups) == 1 for groups in by.values()) and any(r["doc_id"] is None for r in found)
    members = Counter(near for groups in by.values() for near, _ in groups)
    assert all(n == members[near] for groups in by.values() for near, n in groups if near is not None)
    assert editprints.near_groups(editprints.compare_with_next(none)).count() == 0


PAGES = "page_id long, url string, html string, value string, digest string"


def test_warc_odd(spark):
    big, same_text = "ß<p>" * 9000, "<html>" + "copy " * 400
    pages = [(1, "http://a.example/ü x\r\ny", big), (2, None, None), (3, "u", ""), (4, "u", same_text), (9, "u", same_text), (5, "u", same_text), (5, "u", same_text), (None, "u", same_text), (6, "u", "small"), (7, "u", "small"), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 700), (None, None, None)]
    df = spark.createDataFrame([(*p, "v", "d") for p in pages], PAGES)
    expected = []
    for key, _, html in pages:
        data = (html or "").encode()
        top = max((k for k, _, h in pages if h == html and k is not None), default=None)
        again = len(data) >= 1000 and key != top
        expected.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    read = warc.round_trip(df, segment_bytes=700, records_per_file=4)
    same(warc.digests(read).collect(), expected)
    assert {r["url"] for r in read.filter("page_id = 1").collect()} == {"http://a.example/ü x\r\ny"}
    assert warc.round_trip(df.limit(0)).count() == 0
    path = fresh_path(spark, "archive")
    warc.write_archives(df, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).collect()
    kinds = Counter(fields["WARC-Type"] for f in files for fields, _ in warc.parse(bytes(f["content"])))
    visits = [fields for f in files for fields, _ in warc.parse(bytes(f["content"])) if fields["WARC-Type"] == "revisit"]
    assert kinds["warcinfo"] >= 1 and visits and all(v["WARC-Refers-To-Target-URI"] == "u" and "WARC-Refers-To-Date" in v for v in visits)


def test_warc_broken():
    first = {"WARC-Type": "response", "WARC-Record-ID": "<x>"}
    head = "\n".join(f"{k}: {v}" for k, v in first.items()).encode()
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello" * 100, 64)
    good = [(1, None, head, body[:50]), (2, len(body), None, body[50:])]
    assert warc._assemble(good)[2] == b"hello" * 100
    for wrong in (good[:1], good[1:], [good[0], (3, *good[1][1:])], [good[0], (2, 7, None, body[50:])], [*good, good[1]]):
        with pytest.raises(ValueError):
            warc._assemble(wrong)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nhel")


def test_points_below():
    values = [sum((t >> k & 1) << (mixing.BITS - 1 - k) for k in range(20)) for t in range(700)]
    edges = [0, 1, 1 << 40, (1 << 52) // 3, (1 << 52) * 5 // 7, (1 << 52) - 1, 1 << 52]
    for t in (0, 1, 2, 3, 64, 333, 699):
        got = mixing.points_below(np.full(len(edges), t, np.int64), np.array(edges, np.int64))
        assert got.tolist() == [sum(v < e for v in values[:t]) for e in edges]


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]).tolist() == [50, 100, 150]
    got = mixing.targets([1000, 10, 0, 5], [1, 2, 3, 1])
    assert got[1:].tolist() == [30, 0, 15] and got[0] == 1015 - 45


def test_mix_odd(odd, odd_rows, none):
    found = mixing.mix(odd).collect()
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for r in odd_rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([total[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))])))
    same([(r["doc_id"], r["size"], r["source_size"], r["target"]) for r in found], [(r[0], size(r[1]), total[r[3]], goals[r[3]]) for r in odd_rows])
    taken = Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goals[s]) <= max(2, 0.01 * goals[s]) for s in names)
    same(found, mixing.mix(odd.repartition(5, "text")).collect())
    assert mixing.mix(none).count() == 0


def plain_taken(docs, weights=(1, 2, 3), slots=mixing.SLOTS):
    """Words taken of each row of (id, text, source): the slots one by one, each word of each block counted."""
    names = sorted({r[2] for r in docs}, key=lambda x: (x is None, x or ""))
    runs = {n: [] for n in names}
    for i, r in enumerate(docs):
        runs[r[2]] += [(i, len(WORD.findall(r[1] or "")))]
    sizes = [sum(n for _, n in runs[s]) for s in names]
    plan = mixing.Plan(sizes, mixing.targets(sizes, [weights[k % len(weights)] for k in range(len(names))]), slots)
    return names, sizes, plan


@pytest.mark.parametrize("slots", [mixing.SLOTS, 64])
def test_taken_words(spark, slots):
    """taken is the number of words of the blocks that the schedule's slots give, counted slot by slot."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), f"s{k % 5}" if k % 11 else None) for k in range(300)] + [(900, "a b c", "tiny"), (901, "x", "one word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names, sizes, plan = plain_taken(rows, slots=slots)
    takes = Counter()
    for t in range(plan.length):
        point = sum((t >> k & 1) << (mixing.BITS - 1 - k) for k in range(40))
        j = max(k for k in range(len(names)) if plan.edges[k] <= point)
        rank = sum(v for (n, _), v in takes.items() if n == names[j])
        if rank < plan.needs[j]:
            takes[names[j], rank % int(plan.blocks[j])] += 1
    found = mixing.mix(docs, slots=slots).collect()
    for r in found:
        j = names.index(r["source"])
        n, b = sizes[j], int(plan.blocks[j])
        words = range(r["begin"], r["begin"] + r["size"])
        assert r["taken"] == sum(takes[r["source"], ((w + 1) * b - 1) // n] for w in words)
    for j, name in enumerate(names):
        got = sum(r["taken"] for r in found if r["source"] == name)
        assert abs(got - found[[r["source"] for r in found].index(name)]["target"]) <= max(1, n / min(mixing.LEAST_BLOCKS, sizes[j]))


def test_mix_small_sources():
    """A source of one word, or with less than a block of the rest, isn't lost or rounded up."""
    plan = mixing.Plan([10**9, 1000, 1], [10**9, 400.0, 3.0])
    assert (plan.needs * np.array([10**9, 1000, 1]) / plan.blocks)[1:].round().tolist() == [398, 3]
    plan = mixing.Plan([10**9, 1000], [10**9, 1500.0])
    assert plan.needs[1] / plan.blocks[1] == 1.5


@pytest.mark.parametrize("few", [50_000, 0])
def test_repeat_texts(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    rows = [(k, "\n".join(f"w{k}_{i}\t " for i in range(20 + k)), f"s{k % 3}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("_size", "_pass", "size", "taken", "id", "n", "times", "key")})
    mixed = mixing.mix(docs)
    out = mixing.repeat_texts(docs, mixed)
    assert out.columns == docs.columns and out.filter("_size <> 'own' or _pass <> 'own' or size <> 'own' or id <> 'own' or times <> 'own'").isEmpty()
    copies, texts = Counter(), dict((k, t) for k, t, _ in rows)
    for r in out.collect():
        copies[r["doc_id"]] += 1
        assert r["text"] == texts[r["doc_id"]]  # whole documents only
    plan = mixed.collect()
    assert copies == {r["doc_id"]: n for r in plan if (n := (2 * r["taken"] + r["size"]) // (2 * r["size"]))}
    assert all(n <= 3 for n in copies.values())
    for source in {r["source"] for r in plan}:  # a source is off by half a document at most, there is one pass that ends within it
        mine = [r for r in plan if r["source"] == source]
        assert abs(sum(copies[r["doc_id"]] * r["size"] - r["taken"] for r in mine)) <= max(r["size"] for r in mine) / 2


def test_repeat_equal_rows(spark):
    """Rows equal in id and text are one row, taken as often as all of them together; null texts never."""
    rows = [(1, "a b c d", "s", k) for k in range(4)] + [(None, "e f g h", "t", 0), (None, "i j k", "t", 0), (2, None, "t", 0), (2, "", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more int").repartition(3)
    mixed = mixing.mix(docs)
    out = mixing.repeat_texts(docs, mixed).collect()
    assert len(out) == sum((2 * r["taken"] + r["size"]) // (2 * r["size"]) for r in mixed.filter("size > 0").collect())
    assert {r["more"] for r in out} == {0} and {r["doc_id"] for r in out} <= {1, None}
    numbers = docs.filter("doc_id = 1").select("doc_id", F.lit(12).alias("text"), "source")
    assert mixing.repeat_texts(numbers, mixing.mix(numbers)).count() > 0  # a text of another type is its string


def labelled(spark, n=1500):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        good = k % 4 > 0
        text = " ".join(rng.choice(words, 60)) + "." if good else (" ".join(rng.choice(words, 8)).upper() + "!! ") * 7
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, q) for k, q, _ in labels)


def test_classifier(spark, odd, odd_rows, none):
    docs, labels, truth = labelled(spark)
    machine = qualityfm.train(docs, labels, max_train=500)
    out = qualityfm.digests(qualityfm.score(docs, machine)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.98 * len(held)
    rows = qualityfm.score(odd, machine).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert qualityfm.score(none, machine).count() == 0
    blank = qualityfm.train(docs, labels.limit(0))
    assert {r["score"] for r in qualityfm.score(docs.limit(5), blank).collect()} == {0.5}
    one = qualityfm.train(docs, labels.filter("quality = 1"))
    assert min(r["score"] for r in qualityfm.score(docs.limit(5), one).collect()) > 0.99


def test_training_sample_is_bounded(spark):
    """One row an id, however often it stands in the table, and no more features than allowed."""
    docs, labels, _ = labelled(spark, 300)
    often = docs.filter("doc_id = 3").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("k")
    fitted = []

    class Watched(qualityfm.Machine):
        def fit(self, rows, labels):
            fitted.append((len(rows), sum(len(at) for at, _ in rows)))
            return self

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(qualityfm, "Machine", Watched)
        qualityfm.train(docs.union(often), labels, max_train=20)
        qualityfm.train(docs.union(often), labels, max_train=20, max_features=400)
    assert fitted[0][0] == 20 and 0 < fitted[1][0] < 20 and fitted[1][1] <= 400


def test_scores_from_all_pairs(spark):
    """The query's scores, with a trained machine, from the sum over all pairs of features."""
    docs, labels, _ = labelled(spark, 200)
    m = qualityfm.train(docs, labels, max_train=60)
    rows = docs.limit(12).collect()
    got = {r["doc_id"]: r["score"] for r in qualityfm.score(docs.limit(12), m).collect()}
    for r in rows:
        at, value = qualityfm.features(r["text"], r["n_chars"])
        x, v = value.astype(np.float64), m.v[at].astype(np.float64)
        inner = (v @ v.T) * np.outer(x, x)
        margin = m.bias + float((m.w[at] * x).sum()) + float(np.triu(inner, 1).sum())
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-margin))) < 1e-4


def test_pair_identity():
    """The sum-of-squares identity gives what all pairs give."""
    m = qualityfm.Machine()
    m.w[:] = np.random.default_rng(0).normal(size=len(m.w))
    at, value = np.array([3, 77, 500, 9000]), np.array([0.5, 1.0, -2.0, 0.25], np.float32)
    pairs = sum(float(m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(zip(at, value)) for b, y in list(zip(at, value))[i + 1 :])
    got = m.margin(at, value, np.array([0]))[0][0]
    assert abs(got - (m.bias + float((m.w[at] * value).sum()) + pairs)) < 1e-5


def test_pipeline(spark, odd):
    import corpus_pipeline as C

    docs, n = odd, odd.count()
    for name, stage in C.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        if name != C.STAGES[-1][0]:
            assert docs.columns == C.COLUMNS
        if name == "near dedup":
            assert docs.count() <= n and docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0
    empty = odd.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_scratch_tables_go(spark):
    """What a stage writes under way is removed after it; released tables go at once; a cluster needs a shared folder."""
    from types import SimpleNamespace

    from quillsieve.llm import common

    with common.scratch():
        kept = common.written(spark.range(3).toDF("x"), "kept")
        gone = common.written(spark.range(3).toDF("x"), "gone")
        common.release(gone)
        assert kept.count() == 3
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
            spark.read.parquet(gone.inputFiles()[0] if gone.inputFiles() else "/nowhere").count()
        path = kept.inputFiles()[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(path).count()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="none"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)
