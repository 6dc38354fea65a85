"""Information-theoretic sanitisation of personal data.

Base spans are the matches of four fixed patterns. What they protect is a hierarchy: the value (an address, a
number), its group (domain of an e-mail, first two parts of an IP address, area of a phone number, first six
digits of a card), its kind, and personal data as such. A term (a word outside the base spans, A-Z lower-cased)
discloses one of these, e, if their co-occurrence in the corpus says so: with N texts, e in f(e), the term in f(t)
and both in f(t, e),

    PMI(t; e) = log2(N * f(t, e) / (f(t) * f(e)))  comes near  IC(e) = log2(N / f(e)),

what naming e would tell. The bits that stay unknown, IC(e) - PMI(t; e), are -log2 of the probability of e where t
is read; a term is over the threshold if this probability is at least `generalise`. A term counts beside a value or
group within `window` words of it (so work grows with the text, however many entities it names), beside a kind
anywhere in the text. Chance is kept out by the data: all f(t, e) co-occurrences of independent e and t have a
probability of about 2 ** -(f(t, e) * PMI), so these bits must exceed the log2 of the number of pairs that were
looked at by `margin`. Pairs of fewer than `support` texts are not looked at, and what has fewer than
`entity_bits` bits identifies no one. Disclosing terms become spans of kind `term` in all documents, whether
anything is named there or not: replaced by a placeholder from a probability of `generalise` on, removed from
`remove` on, by the entity that they tell most of. Base spans always stay and always go.

Counts cover all documents. Equal texts count once, with base spans or without, so copies neither make evidence
nor hide it. Words are counted by explode and partial aggregation, with the few candidate terms only.

Defined results: a null text is an empty one and stays null when sanitised; a null id is kept; repeated rows
give repeated results; a text of any length is read as a whole; a term that tells equally much of several entities
is one span; an empty table gives an empty result; other columns are ignored (find) or kept (sanitise).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import SPACES, free_name, small_batches, written

KINDS = ("email", "ip", "card", "phone")
#: What is protected whatever its value; PERSONAL is any of the kinds.
PERSONAL = "personal"
#: Candidate terms, and bytes of them, up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 8_000_000
#: Tasks that a key of very many rows is dealt over in joins by shuffle.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed patterns. Possessive forms match what the plain ones do, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(UPPER, LOWER)


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return not total % 10


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.translate(_LOWER)}" if kind in ("email", "ip") else kind + ":" + "".join(c for c in value if c in "0123456789")


def groups(name: str) -> list[str]:
    """An entity and the group that it belongs to."""
    kind, value = name.split(":", 1)
    if kind == "email":
        return [name, "email@" + value.split("@")[1]]
    if kind == "ip":
        return [name, "ip/" + ".".join(value.split(".")[:2])]
    return [name, f"{kind}/" + (value[:6] if kind == "card" else value[: max(len(value) - 7, 1)])]


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def free_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Words, A-Z lower-cased, that no base span touches."""
    ranges: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(b, ranges[-1][1])
        else:
            ranges.append([a, b])
    at, out = 0, []
    for m in _WORD.finditer(text):
        while at < len(ranges) and ranges[at][1] <= m.start():
            at += 1
        if at == len(ranges) or ranges[at][0] >= m.end():
            out.append((m[0].translate(_LOWER), *m.span()))
    return out


def beside(text: str, spans: list[tuple[str, int, int]], words: list[tuple[str, int, int]], window: int) -> dict[str, set[str]]:
    """The terms within `window` words of each value and group."""
    starts, out = [a for _, a, _ in words], {}
    for kind, a, b in spans:
        near = {w for w, _, _ in words[max(bisect_left(starts, a) - window, 0) : bisect_right(starts, b) + window]}
        for name in groups(entity(kind, text[a:b])):
            out.setdefault(name, set()).update(near)
    return out


_COUNTS = "n_email long, n_ip long, n_card long, n_phone long"
_NEAR = "array<struct<entity:string,terms:array<string>>>"


def _held(window: int):
    """Of the texts with base spans only: digest, whether each kind is there, what stands beside it, all terms."""
    near = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))
    kinds = (pa.int64(), *[pa.int64()] * 4, near, pa.list_(pa.string()))

    def run(batches):
        for batch in small_batches(batches):
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if spans := base_spans(text):
                    words, there = free_words(text, spans), {k for k, _, _ in spans}
                    met = [{"entity": e, "terms": sorted(t)} for e, t in sorted(beside(text, spans, words, window).items())]
                    out.append((h, *[int(k in there) for k in KINDS], met, sorted({w for w, _, _ in words})))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=["h", *KINDS, "near", "terms"])

    return run


def _words(text: str):
    """Column: the distinct terms of a text, by the rule of free_words."""
    bare = F.btrim(F.translate(text, UPPER, LOWER), F.lit(SPACES))
    return F.array_distinct(F.split(bare, r"[\x20\x09-\x0D]+"))


def _small(terms: DataFrame, column: str = "term") -> bool:
    n, size = terms.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()  # one row
    return n <= BROADCAST_TERMS and (size or 0) <= BROADCAST_BYTES


def _met(rows: DataFrame, table: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with a written table of one row a key: by broadcast if it is small; else on the key and a salt from
    `by`, so that a key of very many rows is dealt over SALTS tasks, whatever is summed by that key afterwards."""
    if _small(table, on):
        return rows.join(F.broadcast(table), on, how)
    salt = free_name([*rows.columns, *table.columns], "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(by, F.lit(7)), F.lit(SALTS)))
    each = table.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # Spark judges a table by the size of its files, which hold each key once and packed; it would broadcast what is too large
    return dealt.join(each.hint("merge"), [on, salt], how).drop(salt)


def disclosing(held: DataFrame, docs_text: DataFrame, generalise: float, support: int, entity_bits: float, margin: float) -> DataFrame | None:
    """(entity, term, told): told is the probability of the entity where the term is read. held: rows of _held.

    What the documents with spans alone say bounds each PMI from above. Only pairs within that bound are
    counted over the whole corpus, so common words never leave the documents with spans."""
    texts = written(held.dropDuplicates(["h"]).withColumn(PERSONAL, F.lit(1).cast("long")), "held-texts")
    classes = (*KINDS, PERSONAL)
    n = docs_text.select(F.xxhash64("text")).distinct().count()
    totals = texts.agg(*[F.sum(k).alias(k) for k in classes]).first()  # one row
    if not totals[PERSONAL]:
        return None
    # values and groups: pairs within the window
    near = texts.select("h", F.explode("near").alias("e")).select("h", "e.entity", "e.terms")
    entities = written(near.groupBy("entity").agg(F.count(F.lit(1)).alias("fe")).filter(F.col("fe") >= support), "entities")
    pairs = _met(near, entities, "entity", "h").select("entity", "fe", F.explode("terms").alias("term")).groupBy("entity", "fe", "term").agg(F.count(F.lit(1)).alias("fte"))
    pairs = written(pairs.filter(F.col("fte") >= support), "near-pairs")
    # kinds: a handful of sums of one aggregate over terms
    sums = texts.select(*classes, F.explode("terms").alias("term")).groupBy("term").agg(*[F.sum(k).alias(k) for k in classes])
    within = written(sums.filter(F.col(PERSONAL) >= support), "held-terms")
    bits = margin + math.log2(max(pairs.count() + len(classes) * within.count(), 1))

    ic = F.log2(F.lit(float(n)) / F.col("fe"))

    def tells(ft):
        pmi = F.log2(F.lit(float(n)) * F.col("fte") / (F.col("fe") * ft))
        return (ic >= entity_bits) & (F.col("fte") >= generalise * ft) & (pmi * F.col("fte") >= bits)

    of_class = F.explode(F.array(*[F.struct(F.lit(k).alias("entity"), F.lit(totals[k]).cast("long").alias("fe"), F.col(k).alias("fte")) for k in classes]))
    by_class = within.select("term", F.col(PERSONAL).alias("fh"), of_class.alias("c")).select("c.entity", "c.fe", "term", "c.fte", "fh")
    by_value = pairs.join(within.select("term", F.col(PERSONAL).alias("fh")).hint("merge"), "term").select("entity", "fe", "term", "fte", "fh")
    both = by_class.filter(F.col("fte") >= support).unionByName(by_value).filter(tells(F.col("fh")))
    both = written(both.withColumn("others", F.lit(0).cast("long")), "term-pairs")
    # documents are counted in four growing parts; after each, terms that are too common already are out
    for low, high in ((0, 1), (1, 4), (4, 16), (16, 64)):
        terms = written(both.select("term").distinct(), "terms")
        if terms.isEmpty():
            return None
        part = lambda h: F.pmod(h, F.lit(64)).between(low, high - 1)  # noqa: B023, E731
        more = _other_documents(docs_text.filter(part(F.xxhash64("text"))), texts.filter(part(F.col("h"))), terms)
        counted = both.join(more, "term", "left").withColumn("others", F.col("others") + F.coalesce("more", F.lit(0)))
        ft = F.col("fh") + F.col("others")
        both = written(counted.filter(tells(ft)).select("entity", "fe", "term", "fte", "fh", "others"), "told")
    return both.select("entity", "term", (F.col("fte") / (F.col("fh") + F.col("others"))).alias("told"))


def _other_documents(docs_text: DataFrame, held: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, more): distinct texts with the term, less those with base spans."""
    words = docs_text.select(F.xxhash64("text").alias("h"), F.explode(_words("text")).alias("term"))
    every = _met(words, terms, "term", "h", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    copied = _met(held.select("h", F.explode("terms").alias("term")), terms, "term", "h", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("m"))
    return every.join(copied, "term", "left").select("term", F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0)).alias("more"))


def cleaned(text: str, terms: dict[str, bool]) -> tuple[list, list, str]:
    """Base spans, all spans, and the text without them. terms: disclosing ones, and whether they are removed."""
    base = base_spans(text) if any(c in text for c in "@0123456789") else []
    some = terms and not terms.keys().isdisjoint(w.translate(_LOWER) for w in set(_WORD.findall(text)))
    more = [(w, a, b) for w, a, b in free_words(text, base) if w in terms] if some else []
    cuts = sorted([(a, b, f"[{k.upper()}]") for k, a, b in base] + [(a, b, "" if terms[w] else "[TERM]") for w, a, b in more])
    out, at = [], 0
    for a, b, put in cuts:
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return base, base + [("term", a, b) for _, a, b in more], "".join([*out, text[at:]]) if cuts else text


def _terms_of(batch, column: int, rows: int, known: dict[str, bool]):
    """The disclosing terms for each row: one table for all, or the row's own."""
    if column < 0:
        return [known] * rows
    return [{t["term"]: t["removed"] for t in found or []} for found in batch.column(column).to_pylist()]


def _spans_of(known: dict[str, bool], own: int):
    names = ["doc_id", "text_sha256", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text"]
    kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 3)

    def run(batches):
        for batch in small_batches(batches):
            out = []
            for key, text, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _terms_of(batch, own, batch.num_rows, known)):
                base, every, clean = cleaned(text, terms)
                digest = hashlib.sha256(text.encode()).hexdigest() if every else None
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((key, digest, *counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every), clean if every else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)], names=names)

    return run


def _clean_rows(known: dict[str, bool], own: int, at: int, width: int):
    """The first `width` columns, with the text in column `at` cleaned."""

    def run(batches):
        for batch in small_batches(batches):
            texts = zip(batch.column(at).to_pylist(), _terms_of(batch, own, batch.num_rows, known))
            clean = pa.array([None if text is None else cleaned(text, terms)[2] for text, terms in texts], pa.string())
            columns = [clean if k == at else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return run


def marked_terms(docs: DataFrame, text_col: str, generalise: float = 2 / 3, remove: float = 0.95, support: int = 3, entity_bits: float = 2.0, margin: float = 10.0, window: int = 64) -> DataFrame | None:
    """(term, removed): the disclosing terms of the corpus, each once."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    may = texts.filter(F.col("text").rlike("[@0-9]"))  # no base span without
    flags = ", ".join(f"{k} long" for k in KINDS)
    held = may.select(F.xxhash64("text").alias("h"), "text").mapInArrow(_held(window), f"h long, {flags}, near {_NEAR}, terms array<string>")
    found = disclosing(held, texts, generalise, support, entity_bits, margin)
    if found is None:
        return None
    return written(found.groupBy("term").agg((F.max("told") >= remove).alias("removed")), "disclosing")


def with_terms(docs: DataFrame, text_col: str, terms: DataFrame | None) -> tuple[DataFrame, dict[str, bool], int]:
    """docs, the terms, -1; or, where they are too many for every task: docs with the terms of each text as a last
    column, and its number."""
    if terms is None:
        return docs, {}, -1
    if _small(terms):
        return docs, {r["term"]: r["removed"] for r in terms.collect()}, -1
    text, key, found = F.coalesce(F.col(text_col).cast("string"), F.lit("")), free_name(docs.columns, "h"), free_name(docs.columns, "found")
    hits = docs.select(F.xxhash64(text).alias(key), text.alias("text")).select(key, F.explode(_words("text")).alias("term"))
    hits = _met(hits, terms, "term", key).distinct()
    lists = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "removed"))).alias(found))  # bounded by the text
    return docs.withColumn(key, F.xxhash64(text)).join(lists, key, "left").drop(key), {}, len(docs.columns)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text_sha256, n_email, n_ip, n_card, n_phone, base_sha256, spans and clean_text (null digest and text
    where nothing was found). options: those of marked_terms."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, known, own = with_terms(source, "text", marked_terms(source, "text", **options))
    return rows.mapInArrow(_spans_of(known, own), f"doc_id long, text_sha256 string, {_COUNTS}, base_sha256 string, spans string, clean_text string")


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with cleaned texts; every other column stays as it is. No text moves unless the terms are too many to be
    known to every task."""
    source = docs.withColumn(text_col, F.col(text_col).cast("string"))
    rows, known, own = with_terms(source, text_col, marked_terms(source, text_col, **options))
    return rows.mapInArrow(_clean_rows(known, own, source.columns.index(text_col), len(source.columns)), source.schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
