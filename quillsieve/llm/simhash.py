"""SimHash near duplicates with BK-trees.

Every text gets a 64-bit fingerprint. Equal fingerprints are one node, so copies never meet in pairs.
Two fingerprints within `radius` bits agree on at least blocks - radius of their `blocks` equal parts;
each choice of that many parts is a mask, and a shard holds the fingerprints that agree under one mask. A shard
gets its own BK-tree (children keyed by integer Hamming distance to the parent; a search follows only
edges within the radius) and each of its fingerprints is looked up there. All trees together grow with the
corpus, so they are not broadcast: trees and look-ups meet by shard key in one task. A shard of more than
`most` fingerprints is split again by the same argument on its remaining bits, so no shard is unbounded
and no link is lost. A shard gives at most one link per fingerprint; components come from minimum labels
with pointer jumping.

Defined results: null and empty texts (no words) have fingerprint zero, which links like any other; a null
id is no one's component id unless its component has no other id; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import shuffle_partitions, small_batches, written

FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six ASCII spaces split
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): fp has the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches):
            fps = [signed(simhash(t, width, seed)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    def __init__(self):
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = [x, {}]
                return
            node = node[1][d]

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            todo += [child for e, child in children.items() if d - radius <= e <= d + radius]
        return found


def parts(bits: list[int], n: int) -> list[int]:
    """The bits in n masks of nearly equal size."""
    return [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def masks(radius: int, blocks: int, within: int = FULL) -> list[int]:
    """Masks over the bits of `within`: any two values at most radius bits apart there agree under one."""
    cut = [m for m in parts([b for b in range(64) if within >> b & 1], blocks) if m]
    return sorted({sum(c) for c in combinations(cut, len(cut) - radius)}) if len(cut) > radius else []


def _shard_links(radius: int):
    """One link (fp, root) for each fingerprint that another one of its shard reaches; rows come sorted by shard."""

    def links(members: list[int]) -> Iterator[tuple[int, int]]:
        parent = {x: x for x in members}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        tree = BKTree()
        for x in members:
            for y in tree.within(x, radius):
                a, b = top(x), top(y)
                parent[max(a, b)] = min(a, b)
            tree.add(x)
        return ((x, top(x)) for x in members if top(x) != x)

    def run(batches: Iterator[pa.RecordBatch]):
        shard, members = None, []

        def flush():
            out = list(links(members)) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([signed(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for mask, value, fp in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (mask, value) != shard:
                    if len(members) > 1:
                        yield flush()
                    shard, members = (mask, value), []
                members.append(fp & FULL)
        if len(members) > 1:
            yield flush()

    return run


def links(nodes: DataFrame, radius: int = 2, blocks: int = 4, most: int = 4096) -> DataFrame:
    """(a, b): links that connect all fingerprints of `nodes` (fp, each once) at most radius bits apart."""
    p = shuffle_partitions(nodes.sparkSession)
    todo = nodes.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks(radius, blocks)])).alias("mask"))
    out = None
    while True:
        keyed = todo.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        sizes = written(keyed.groupBy("mask", "value").count().filter("count > 1"), "simhash-shards")
        # masks that leave no way to split on: at most 2 ** (2 * radius) values are left under them
        finest = F.bit_count(F.bitwise_not(F.col("mask"))) <= 2 * (radius + 1)
        small = keyed.join(sizes.filter((F.col("count") <= most) | finest).drop("count"), ["mask", "value"], "left_semi")
        found = small.repartition(p, "mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_shard_links(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        large = sizes.filter((F.col("count") > most) & ~finest).drop("count")
        kinds = [r["mask"] for r in large.select("mask").distinct().collect()]  # masks, not data: a few dozen at most
        if not kinds:
            return out.distinct()
        finer = F.create_map(*[x for m in kinds for x in (F.lit(m), F.array(*[F.lit(signed((m & FULL) | n)) for n in masks(radius, radius + 1, FULL & ~m)]))])
        todo = keyed.join(large, ["mask", "value"], "left_semi").select("fp", F.explode(finer[F.col("mask")]).alias("mask"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches. Labels are written each round."""
    n = 2 * edges.count()
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "links", n)
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels", n)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        after = written(lower.join(jump, "to").select("node", F.least("to", "further").alias("label"), "was"), "labels", n)
        labels = after.select("node", "label")
        if after.filter("label <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = 4096) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that the document reaches over links)."""
    marked = written(fingerprints(docs, width, seed, id_col, text_col), "simhash")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    linked = components(written(links(nodes.select("fp"), radius, most=most), "simhash-links")).select(F.col("node").alias("fp"), "label")
    named = nodes.join(linked, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def linked_texts(docs: DataFrame, width: int = 5, radius: int = 2, seed: int = 42, text_col: str = "text") -> DataFrame:
    """(a, b): each text (its xxhash64) of a component and the component's smallest one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = fingerprints(docs.select(F.xxhash64(text).alias("node"), text.alias("text")), width, seed, "node", "text")
    nodes = written(marked.distinct().withColumnRenamed("doc_id", "node"), "simhash-texts")
    linked = components(written(links(nodes.select("fp").distinct(), radius), "simhash-links")).select(F.col("node").alias("fp"), "label")
    named = nodes.join(linked, "fp", "left").select("node", F.coalesce("label", "fp").alias("label"))
    heads = named.groupBy("label").agg(F.min("node").alias("b"))
    return named.join(heads, "label").filter("node <> b").select(F.col("node").alias("a"), "b")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
