"""Near duplicates by the exact Jaccard similarity of word shingles, at least 0.8.

A text is the set of its shingles of `width` words (64-bit hashes). Candidates come from prefix filtering, which
loses no pair: with all shingles in one fixed order, two sets of similarity 0.8 share one of their first
n - ceil(0.8 n) + 1. Shingles that are common in a sample of the texts come last in that order, so boilerplate
makes few candidates; the sample decides the work, never the result. A candidate pair first meets as parity sketches of about a
bit a shingle: each shingle of only one of the sets flips one bit, so the bits that differ are no more than these shingles,
and a pair with too many of them can't be similar. Pairs within that bound are verified on the whole sets. Groups are connected components of the verified pairs. Pairs found before (by SimHash, say) are verified first and
spare the texts that they join the meeting in pairs.

Equal texts are one node. Texts that share a shingle of their prefixes are a bucket of buckets.links.

Defined results: null and empty texts (no words) are equal to each other; texts of fewer than `width` words are one
shingle; a null id is no one's component id unless its component has no other id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm import buckets
from quillsieve.llm.common import BitMap, release, small_batches, written
from quillsieve.llm.simhash import components

#: Shingles known as common, at most: they go to every task. One text in SAMPLE is looked at for them.
COMMON = 200_000
SAMPLE = 16
#: Bits of the map that tells most shingles of one text only from shared ones.
BITS = 1 << 25
NEED_BITS = 1 << 22


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; words as in simhash."""
    words, digest = (text or "").encode().lower().split(), xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(words[k : k + width]), seed) for k in range(max(1, len(words) - width + 1))]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is at least 0.8."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * shared >= 4 * (len(x) + len(y) - shared)


def sketch(every: np.ndarray) -> bytes:
    """Parity of the number of shingles at each of a power of two of places."""
    m = max(256, 1 << (len(every) - 1).bit_length())
    return np.packbits(np.bincount(every & (m - 1), minlength=m).astype(np.uint8) & 1).tobytes()


def may_be_similar(x: bytes, y: bytes, n: int) -> bool:
    """False only if two sets of n shingles together have a similarity below 0.8, by their sketches."""
    a, b = (np.frombuffer(s, np.uint8) for s in (x, y))
    if len(a) != len(b):
        m = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (a, b))
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n


def _once(batches, wanted: BitMap | None = None):
    """(node, text) of each text that the task hasn't had and that may be wanted."""
    seen = set()
    for batch in small_batches(batches, lean=True):
        nodes, new = batch.column(0).to_numpy(), []
        some = range(len(nodes)) if wanted is None else np.flatnonzero(wanted(nodes)).tolist()
        for k in some:
            node = int(nodes[k])
            if node not in seen:
                seen.add(node)
                new.append(k)
        part = batch.take(pa.array(new, pa.int64()))
        yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))


def _tokens(width: int):
    def run(batches):
        for rows in _once(batches):
            sets = [shingles(text, width) for _, text in rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64())], names=["token"])

    return run


def _prefixes(width: int, tokens: np.ndarray, ranks: np.ndarray):
    """tokens: the common shingles, sorted, and their counts."""

    def run(batches):
        for rows in _once(batches):
            columns, sketches = [[np.zeros(0, np.int64)] for _ in range(4)], []
            for node, text in rows:
                every = shingles(text, width)
                n, rank = len(every), np.zeros(len(every), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, every), len(tokens) - 1)
                    rank = np.where(tokens[at] == every, ranks[at], 0)
                first = every[np.lexsort((every, rank))][: n + (-4 * n // 5) + 1]
                for column, values in zip(columns, (first, np.full(len(first), node, np.int64), np.full(len(first), n, np.int64), np.arange(len(first)))):
                    column.append(values)
                sketches += [sketch(every), *[None] * (len(first) - 1)]
            numbers = [pa.array(np.concatenate(c), pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(sketches, pa.binary())], names=["token", "node", "size", "at", "sketch"])

    return run


def _sets(width: int, wanted: BitMap):
    def run(batches):
        for rows in _once(batches, wanted):
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([shingles(t, width).tobytes() for _, t in rows], pa.binary())], names=["node", "set"])

    return run


def _verified(batches):
    for batch in small_batches(batches, lean=True):
        found = [(a, b) for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))) if similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _possible(batches):
    for batch in small_batches(batches, lean=True):
        found = [(a, b) for a, b, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(5))) if may_be_similar(x, y, n)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _verify(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of nodes that are similar."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    met = pairs.join(sketches.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x")), "a")
    met = met.join(sketches.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y")), "b")
    pairs = written(met.select("a", "b", F.col("m") + F.col("n"), "x", "y").mapInArrow(_possible, "a long, b long"), "shingle-pairs")
    if pairs.isEmpty():
        return pairs
    need = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    sets = texts.select("node", "text").mapInArrow(_sets(width, BitMap(need, "node", NEED_BITS)), "node long, set binary")
    sets = written(sets.groupBy("node").agg(F.max("set").alias("set")), "shingle-sets")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "y"}), "b")
    found = written(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "shingle-links")
    release(sets)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", small: int = buckets.SMALL, pairs: DataFrame | None = None) -> DataFrame:
    """doc_id, node (hash of the text), label (of the component), component_id (its smallest doc_id). pairs: candidates
    (a, b) of nodes that are known beforehand."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    marked = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node")), "shingle-nodes")
    sample = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(_tokens(width), "token long")
    often = sample.groupBy("token").count().filter("count > 2").orderBy(F.desc("count"), "token").limit(COMMON).toArrow().sort_by("token")
    common = tuple(often.column(c).to_numpy().astype(np.int64) for c in ("token", "count"))
    entries = written(texts.mapInArrow(_prefixes(width, *common), "token long, node long, size long, at long, sketch binary"), "shingle-prefixes")
    sketches = written(entries.filter("sketch is not null").groupBy("node").agg(F.max("size").alias("size"), F.max("sketch").alias("sketch")), "shingle-sketches")
    entries = entries.drop("sketch")
    # copies in other tasks count too; they fall together after the few shingles left have moved
    again = written(entries.groupBy("token").count().filter("count > 1").select("token"), "shingle-repeated")
    some = BitMap(again, "token", BITS).keep(entries, "token").join(again, "token", "left_semi").distinct()
    some = written(some, "shingle-some")
    shared = some.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("token")
    live = written(some.join(shared, "token", "left_semi"), "shingle-shared")
    for done in (entries, again, some):
        release(done)
    near = (5 * F.least("a_size", "b_size") >= 4 * F.greatest("a_size", "b_size")) & (F.col("a") != F.col("b"))
    enough = 9 * F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) >= 4 * (F.col("a_size") + F.col("b_size"))  # at the first shingle they share
    links = buckets.links(live, lambda found: _verify(texts, sketches, found, width), near, enough, pairs, small)
    known = components(links).withColumnRenamed("label", "known")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least")).join(known, "node", "left").select("node", "least", F.coalesce("known", "node").alias("label"))
    nodes = written(nodes, "shingle-components")
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.join(nodes.join(least, "label").select("node", "label", "component_id"), "node").select("doc_id", "node", "label", "component_id")
