"""Operators on single texts against plain Python: PII, BPE, host rules, SimHash, repeats."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve.llm import bpe, colbwt, hostrules, pii, repeats, shingles, simhash
from quillsieve.llm.queries import TOKENIZER

from .conftest import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a@.-+ ()0149\n%é"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_odd(odd, odd_rows, none):
    found = pii.digests(pii.find(odd)).collect()
    expected = []
    for row in odd_rows:
        spans = plain_spans(row[1] or "")
        spelled = pii.spelled(spans)
        expected.append((row[0], *[sum(k == kind for k, _, _ in spans) for kind in pii.KINDS], hashlib.sha256(spelled.encode()).hexdigest(), spelled))
    same(found, expected)
    assert pii.digests(pii.find(none)).count() == 0


FILLER = ["the report was sent to many people today", "we met again and spoke about the plan", "nothing else happened in the long week"]


def plain_terms(texts, generalise=2 / 3, remove=0.95, support=3, entity_bits=2.0, margin=10.0, window=64):
    """Disclosing terms and whether they are removed, from all pairs of all distinct texts."""
    texts = sorted({t or "" for t in texts})
    f_t, f_te, held, tested = Counter(), Counter(), set(), set()
    for text in texts:
        spans = plain_spans(text)
        free = [m for m in WORD.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        say = lambda m: "".join(c.lower() if c.isascii() else c for c in m[0])
        f_t.update({say(m) for m in free})
        pairs = {(c, say(m)) for c in {"personal", *(k for k, _, _ in spans)} for m in free} if spans else set()
        for kind, a, b in spans:
            value, digits = text[a:b].lower(), re.sub("[^0-9]", "", text[a:b])
            group = {"email": "d" + value.rpartition("@")[2], "ip": "i" + ".".join(value.split(".")[:2]), "card": "c" + digits[:6], "phone": "p" + digits[:-7]}[kind]
            before, after = [m for m in free if m.start() < a], [m for m in free if m.start() > b]
            near = before[-window:] + after[:window]
            names = [(kind, value if kind in ("email", "ip") else digits), (kind, group)]
            pairs |= {(n, say(m)) for n in names for m in near}
            held.update({(n, text) for n in names})
        f_te.update(pairs)
        tested |= {say(m) for m in free} if spans else set()
    f_e = Counter(e for e, _ in held)
    for c in ("email", "ip", "card", "phone"):
        f_e[c] = sum(any(k == c for k, _, _ in plain_spans(t)) for t in texts)
    f_e["personal"] = sum(bool(plain_spans(t)) for t in texts)
    enough = {t for t in tested if f_te["personal", t] >= support}
    looked = sum(n >= support for (e, _), n in f_te.items() if isinstance(e, tuple)) + 5 * len(enough)
    bits, out = margin + np.log2(max(looked, 1)), {}
    for (e, t), n in f_te.items():
        if n >= support and f_e[e] >= support:
            ic, pmi = np.log2(len(texts) / f_e[e]), np.log2(len(texts) * n / (f_t[t] * f_e[e]))
            if ic >= entity_bits and n >= generalise * f_t[t] and pmi * n >= bits:
                out[t] = out.get(t, False) or n / f_t[t] >= remove
    return out


def disclosing_texts():
    """One address with a code word of its own, a mail domain with another, all personal data with a third that also
    stands elsewhere now and then, and common words."""
    texts = [f"{FILLER[k % 3]} number{k}" for k in range(400)]
    texts += [f"write to ann@corp.example about Bluefin {FILLER[k % 3]} case{k}" for k in range(9)]
    texts += [f"b{k}@guild.example is of the Lodge {FILLER[k % 3]}" for k in range(8)]
    texts += [f"10.{k}.3.{k} secret= x{k} {FILLER[k % 3]}" for k in range(20)] + [f"the secret= of {k}" for k in range(4)] + [f"call +1 (555) 010-{1000 + k} secret= {FILLER[k % 3]}" for k in range(9)]
    return [*texts, "my secret= is safe", "we spoke of BLUEFIN again", "bluefins are fish", "Bluefin or bob@corp.example", None, ""]


@pytest.mark.parametrize("most", [200_000, 0])
def test_pii_terms(spark, monkeypatch, most):
    """The terms of the production parameters, by broadcast and by shuffle; copies hide and prove nothing."""
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    texts = disclosing_texts()
    terms = plain_terms(texts)
    assert {"bluefin", "lodge", "secret="} <= set(terms) and not {"the", "week", "report"} & set(terms) and set(terms.values()) == {True, False}
    rows = list(enumerate(texts + ["the Bluefin notice that all have read"] * 300 + [texts[400]] * 50))
    rows = [(k, t) for k, t in rows if t != "we spoke of BLUEFIN again"]
    terms = plain_terms([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(out) == len(rows)
    for k, text in rows:
        spans = plain_spans(text or "")
        more = [m for m in WORD.finditer(text or "") if "".join(c.lower() if c.isascii() else c for c in m[0]) in terms and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        assert out[k]["spans"] == pii.spelled(spans + [("term", *m.span()) for m in more])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert {k: t for k, t in clean.items()} == {k: t if out[k]["clean_text"] is None else out[k]["clean_text"] for k, t in rows}
    assert not any("Bluefin" in (t or "") for t in clean.values()) and any("[TERM]" in (t or "") for t in clean.values())


def test_sanitise_keeps_columns(odd, odd_rows):
    """Clashing and other columns stay; only texts change, and null texts stay null."""
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns
    same(clean.drop("text").collect(), odd.drop("text").collect())
    assert clean.filter("text is null").count() == sum(r[1] is None for r in odd_rows)


def test_bpe_odd(odd, odd_rows, none):
    tokenizer = bpe.load_tokenizer(TOKENIZER)
    expected = []
    for row in odd_rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(bpe.digests(bpe.decode(bpe.encode(odd, TOKENIZER, chunk_chars=2000, buckets=7), TOKENIZER)).collect(), expected)
    assert bpe.digests(bpe.decode(bpe.encode(none, TOKENIZER), TOKENIZER)).count() == 0


def test_bpe_partitions_of_equal_texts(spark):
    """Partitions of one repeated text are chunks of their own, and so groups of their own."""
    docs = spark.createDataFrame([(k, "the same words again") for k in range(80)], "doc_id long, text string").repartition(8)
    names = docs.mapInArrow(bpe._positions_of(bpe.special_pattern(TOKENIZER), 10**6), "chunk string, key long, positions binary").groupBy("chunk").count().collect()
    assert len(names) == 8 and sum(r["count"] for r in names) == 80
    out = bpe.digests(bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER)).collect()
    assert len(out) == 80 and len({r["ids_sha256"] for r in out}) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab' \n\t\x0b\x1c\xa0 é1,!<|endoftx>"), max_size=40))
def test_cuts_keep_ids(text):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["k", "t"])
    (_, positions, words), *_ = bpe._chunks(iter([batch]), bpe.special_pattern(TOKENIZER), 10**6, True)
    tokenizer = bpe.load_tokenizer(TOKENIZER)
    ids = [i for p in bpe._unpack(positions[0]).tolist() for i in tokenizer.encode(words[p], add_special_tokens=False).ids]
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids and "".join(words[p] for p in bpe._unpack(positions[0]).tolist()) == text


def plain_measures(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_host_rules_odd(odd, odd_rows, none):
    judged = hostrules.judge(odd, host_rate=0.5)
    measures = [(r[0], *plain_measures(r[1] or "")) for r in odd_rows]
    same([r[:-1] for r in hostrules.digests(judged).collect()], measures)
    assert all(not r["kept"] for r in judged.filter("base_failed").collect())
    from pyspark.sql import functions as F

    assert set(odd.columns) - set(judged.columns) <= set(hostrules.MEASURES)
    clash = odd.withColumns({c: F.lit(c) for c in ("qrhost", "_qr_host", "_qr_n_lines", "_qr_words", "row", "host", "bad")})
    again = hostrules.judge(clash)
    same(hostrules.digests(again).collect(), hostrules.digests(judged).collect())
    assert again.filter("qrhost <> 'qrhost' or _qr_host <> '_qr_host' or host <> 'host' or row <> 'row' or bad <> 'bad'").isEmpty()
    assert {"qrhost", "_qr_host", "_qr_n_lines", "_qr_words", "row", "host", "bad"} <= set(again.columns)
    assert hostrules.digests(hostrules.judge(none)).count() == 0


def test_host_rejected(spark):
    good, bad = " ".join(f"word{k}" for k in range(40)), "too short"
    rows = [(k, bad if k % 10 else good, "worst") for k in range(60)] + [(100 + k, good if k % 10 else bad, f"fine{k % 5}") for k in range(100)]
    out = {r["doc_id"]: r["kept"] for r in hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[k] for k in range(60))
    assert all(out[100 + k] == bool(k % 10) for k in range(100))


def plain_simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def linked(values, radius):
    """Smallest index that each index reaches."""
    top = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if (values[i] ^ values[j]).bit_count() <= radius and top[j] < top[i]:
                    top[i], changed = top[j], True
    return top


def test_simhash_odd(odd, odd_rows, none):
    fps = [plain_simhash(r[1]) for r in odd_rows]
    top = linked(fps, 2)
    least = defaultdict(list)
    for t, r in zip(top, odd_rows):
        least[t] += [r[0]] if r[0] is not None else []
    expected = [(r[0], f"{f:016x}", min(least[t], default=None)) for r, f, t in zip(odd_rows, fps, top)]
    same(simhash.digests(simhash.near_duplicates(odd)).collect(), expected)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_simhash_links(spark, most):
    import random

    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(25)} | {0, 1, simhash.FULL})
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    out = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, 2, most=most)).collect()}
    top = linked(values, 2)
    groups, expected = defaultdict(set), defaultdict(set)
    for v, t in zip(values, top):
        expected[t].add(v)
        groups[out.get(simhash.signed(v), simhash.signed(v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def plain_groups(texts):
    """Components of all pairs whose sets of five-word shingles have similarity 0.8 or more, by brute force."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and top[a] != top[b]:
                top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
    return top


def near_texts():
    """Families of edited copies (chains, a star around one text that is not the first), shared passages, boilerplate."""
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))

    def edit(text, n):
        words = text.split()
        for k in rng.choice(len(words), n, replace=False):
            words[k] = f"x{rng.integers(0, 10**9)}"
        return " ".join(words)

    texts, boiler = [], say(60)
    for n in (22, 40, 100, 300):
        base = say(n)
        texts += [edit(base, k) for k in (1, 1, 2, 4)] + [base, base, base.upper(), base + " " + say(n // 10)]
    star = say(150)
    texts += [edit(star, 3) for _ in range(40)] + [star]
    texts += [boiler + " " + say(int(k)) for k in rng.integers(3, 90, 40)]
    chain = [say(120)]
    for _ in range(8):
        chain.append(edit(chain[-1], 2))
    return [*texts, *chain, None, "", "one two", "One  two", "one two three"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 700), st.integers(0, 150), st.integers(0, 150))
def test_sketches_reject_no_similar_pair(seed, shared, more, other):
    x, y, z = (np.random.default_rng([seed, k]).integers(-(2**63), 2**63, n) for k, n in enumerate((shared, more, other)))
    a, b = np.unique(np.concatenate([x, y])), np.unique(np.concatenate([x, z]))
    if shingles.similar(a, b):
        assert shingles.may_be_similar(shingles.sketch(a), shingles.sketch(b), len(a) + len(b))


@pytest.mark.parametrize("small", [32, 1])
def test_shingle_groups(spark, small):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs, small=small).collect()}
    top, least = plain_groups(texts), {}
    for k, t in enumerate(top):
        least.setdefault(t, k)
    assert found == {k: least[t] for k, t in enumerate(top)}
    assert shingles.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as C

    texts = near_texts()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    top, first = plain_groups(texts), {}
    for k, t in enumerate(top):
        first.setdefault(t, k)
    assert sorted(r["doc_id"] for r in C.near_dedup(spark, docs, "").collect()) == sorted(first.values())


def test_pipeline_keeps_equal_ids_of_different_groups(spark):
    import corpus_pipeline as C

    say = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, say("a")), (1, say("b")), (1, say("b")), (2, say("b")), (2, say("c")), (None, say("c")), (None, say("d")), (None, say("d"))]
    docs = spark.createDataFrame([(k, t, "en", f"s{i}", len(t)) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in C.near_dedup(spark, docs.repartition(3), "").collect()]
    assert sorted(kept, key=lambda x: x[1]) == [(1, say("a")), (1, say("b")), (2, say("c")), (None, say("d"))]


def plain_removed(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 1])
def test_repeats_odd(odd, odd_rows, none, most):
    expected = [(r[0], *x) for r, x in zip(odd_rows, plain_removed([r[1] for r in odd_rows], 400))]
    found = repeats.digests(repeats.remove(odd, most=most))
    same(found.drop("text").collect(), expected)
    if most == 1:
        assert repeats.remove(none).count() == 0


@pytest.mark.parametrize("most", [4096, 8, 2])
def test_repeats_hot_passage(spark, most):
    """A passage that many texts share, whole, cut or edited, between other words; some texts have it twice."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    passage = say(260)
    texts = []
    for k in range(40):
        cut = passage[: 500 + 20 * k] if k % 4 == 0 else passage[17 * k :] if k % 4 == 1 else passage.replace("w1", f"v{k}", 1 + k % 3) if k % 4 == 2 else passage
        texts.append(say(20 + k) + " " + cut + " " + say(10) + (" " + passage if k % 9 == 0 else ""))
    texts += [texts[3], passage, "é" * 500 + passage, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = [(k, *x) for k, x in enumerate(plain_removed(texts, 400))]
    found = repeats.digests(repeats.remove(docs, most=most)).collect()
    same([r[:5] for r in found], expected)
    assert all(passage[:450] not in r["text"] for r in found)


def test_anchors_of_long_texts(monkeypatch):
    """Parts overlap so that each window comes once, with the anchor that it has by itself."""
    data = np.frombuffer(np.random.default_rng(2).integers(97, 100, 3000, np.uint8).tobytes() * 2, np.uint8)
    monkeypatch.setattr(repeats, "PART", 700)
    rows = repeats.anchors(data, 40, 12)
    windows = [(k, h, p - k) for h, first, last, p in rows for k in range(first, last + 1)]
    assert sorted(k for k, _, _ in windows) == list(range(len(data) - 39))
    assert all([(h, p)] == [(x[0], x[3]) for x in repeats.anchors(data[k : k + 40], 40, 12)] for k, h, p in windows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=14).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=8), st.integers(1, 3), st.integers(1, 3))
def test_column_wise_transform(strings, block, times):
    width = block * times
    seen = Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
    assert [list(map(bool, m)) for m in colbwt.repeated(strings, width, block)] == [[seen[s[i : i + width]] > 1 for i in range(len(s) - width + 1)] for s in strings]
