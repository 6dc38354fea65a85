"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule is the van der Corput point of t (bits of t reversed, a binary fraction), mapped
through the cumulative weights of the sources. How many of the first t points fall into an interval has a
closed form, so every slot knows its rank within its source by itself: no sort, no window over a source.
Each source is shuffled by hash and cut into blocks of equal words, LEAST_BLOCKS at least, so that small sources
reach their targets too; the slot of rank k takes block k mod (number of blocks), until the source has its share.
Blocks are places in the shuffled run of a source's words, found by prefix sums over hash buckets, so a source of
any size is dealt over all tasks.

Names of sources stay in Spark; the driver holds a few numbers for each source, whatever their names.

Defined results: null and empty texts have size 0 and are never taken; the null source is one of its own,
after all others; repeated rows are places of their own; ties of the hash go by id, then by size; a text of any
length may lie in many blocks; if all sizes are 0 nothing is taken; an empty table gives an empty result; other
columns are ignored (mix) or kept (repeat_texts).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsieve.llm.common import count_words, free_name, shuffle_partitions, written

SLOTS = 1 << 18
LEAST_BLOCKS = 256
BITS = 52
BUCKET_BITS = 12
#: Sources up to which their table is broadcast; beyond it rows and sources meet by shuffle.
BROADCAST_SOURCES = 50_000


def targets(sizes, weights, most: float = 3.0) -> np.ndarray:
    """Shares of the sum of sizes by weight; none above `most` times its size, the excess reshared by weight."""
    sizes, weights = np.asarray(sizes, np.int64), np.asarray(weights, np.float64)
    out, left = np.zeros(len(sizes)), float(sizes.sum())
    free = (sizes > 0) & (weights > 0)
    while free.any():
        share = left * weights / weights[free].sum()
        above = free & (share > most * sizes)
        if not above.any():
            out[free] = share[free]
            break
        out[above] = most * sizes[above]
        left -= float(out[above].sum())
        free &= ~above
    return out


def reversed_bits(t: np.ndarray) -> np.ndarray:
    out = np.zeros_like(t)
    for k in range(BITS):
        out |= (t >> k & 1) << (BITS - 1 - k)
    return out


def points_below(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the points of 0 .. t-1 are below x (in units of 2 ** -BITS); t and x alike in shape."""
    count, start = np.zeros_like(t), np.zeros_like(t)
    for k in reversed(range(BITS)):
        has = (t >> k & 1) == 1
        # the points of start .. start + 2**k - 1 lie 2**(BITS - k) apart, from the point of start on
        n = np.clip(-((reversed_bits(start) - x) >> (BITS - k)), 0, 1 << k) if has.any() else 0
        count += np.where(has, n, 0)
        start += np.where(has, np.int64(1) << k, 0)
    return count


class Plan:
    """Blocks, needs and point intervals of the sources, given by size and target."""

    def __init__(self, sizes, goals, slots: int = SLOTS, least: int = LEAST_BLOCKS):
        sizes, goals = np.asarray(sizes, np.int64), np.asarray(goals, np.float64)
        block = max(1, -(-int(sizes.sum()) // slots))
        self.blocks = np.minimum(np.maximum(np.rint(sizes / block).astype(np.int64), least), sizes)
        wanted = np.rint(goals * self.blocks / np.maximum(sizes, 1)).astype(np.int64)
        self.needs = np.minimum(wanted, 3 * self.blocks)
        shares = [0, *np.cumsum(self.needs).tolist()]
        self.edges = np.array([(x << BITS) // max(shares[-1], 1) for x in shares], np.int64)
        self.length = self._length()

    def _counts(self, t: int) -> np.ndarray:
        below = points_below(np.full(len(self.edges), t, np.int64), self.edges)
        return np.diff(below)

    def _length(self) -> int:
        """The least number of slots that gives each source its need."""
        needs = self.needs
        if not needs.sum():
            return 0
        low, high = 0, int(needs.sum())
        while (self._counts(high) < needs).any():
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if (self._counts(mid) < needs).any() else (low, mid)
        return high


def schedule(spark: SparkSession, plan: Plan) -> DataFrame:
    """(slot, source_no, rank, block): slots that sources with a need left take, in order of slot."""
    edges, needs, blocks = plan.edges, plan.needs, plan.blocks

    def run(batches):
        for batch in batches:
            t = batch.column(0).to_numpy().astype(np.int64)
            at = np.searchsorted(edges, reversed_bits(t), side="right") - 1
            at = np.minimum(at, len(needs) - 1)
            rank = points_below(t, edges[at + 1]) - points_below(t, edges[at])
            use = rank < needs[at]
            at, rank = at[use], rank[use]
            yield pa.RecordBatch.from_arrays([pa.array(t[use]), pa.array(at.astype(np.int32)), pa.array(rank), pa.array(rank % np.maximum(blocks[at], 1))], names=["slot", "source_no", "rank", "block"])

    return spark.range(0, plan.length, 1, shuffle_partitions(spark)).mapInArrow(run, "slot long, source_no int, rank long, block long")


def prepare(docs: DataFrame, weights=(1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, most: float = 3.0):
    """The sized rows (written), the sources' frame and the plan. weights repeat over sources by code point."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    size = count_words(text)
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(text).alias("text_key"),
        F.xxhash64(F.col(id_col).cast("long"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(9)).alias("hash"),
    )
    sized = written(sized, "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    named = written(sums.withColumn("place", F.monotonically_increasing_id()), "sources")
    numbers = named.select("place", "source_size").toArrow().to_pandas().sort_values("place", ignore_index=True)  # two numbers a source
    sizes = numbers["source_size"].to_numpy(np.int64)
    numbers["target"] = targets(sizes, np.resize(np.array(weights, np.float64), len(sizes)), most)
    plan = Plan(sizes, numbers["target"], slots)
    numbers["blocks"], numbers["source_no"] = plan.blocks, np.arange(len(sizes), dtype=np.int32)
    known = spark.createDataFrame(numbers if len(numbers) else [], "place long, source_size long, target double, blocks long, source_no int")
    sources = named.drop("source_size").join(known, "place").drop("place")
    return sized, sources, plan


def placed(sized: DataFrame, sources: DataFrame, few: bool = False) -> DataFrame:
    """Sized rows with their source's columns and `begin`, their place in its shuffled run of words."""
    known = sized.withColumnRenamed("source", "_s").join(F.broadcast(sources) if few else sources, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    known = known.withColumn("bucket", F.shiftrightunsigned("hash", 64 - BUCKET_BITS))
    sums = known.groupBy("source_no", "bucket").agg(F.sum("size").alias("sum"))
    before = sums.select("source_no", "bucket", (F.sum("sum").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("sum")).alias("before"))
    run = Window.partitionBy("source_no", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.join(before, ["source_no", "bucket"]).withColumn("begin", F.col("before") + F.sum("size").over(run) - F.col("size")).drop("bucket", "before")


def mix(docs: DataFrame, weights=(1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, begin (place in the source's run)
    and text_key (hash of the text)."""
    spark = docs.sparkSession
    sized, sources, plan = prepare(docs, weights, id_col, text_col, source_col, slots, most)
    rows = placed(sized, sources, len(plan.needs) <= BROADCAST_SOURCES)
    times = schedule(spark, plan).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))

    def border(i):
        return F.expr(f"({i}) * source_size div blocks")

    full = rows.filter("size > 0")
    pieces = full.select(
        "doc_id", "source_no", "size", "begin", "source_size", "blocks",
        F.explode(F.expr("sequence(((begin + 1) * blocks - 1) div source_size, ((begin + size) * blocks - 1) div source_size)")).alias("block"),
    )
    words = F.least(F.col("begin") + F.col("size"), border("block + 1")) - F.greatest(F.col("begin"), border("block"))
    used = pieces.withColumn("words", words).join(times, ["source_no", "block"])
    taken = used.groupBy(F.col("source_no").alias("_no"), F.col("begin").alias("_begin")).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = rows.join(taken, (F.col("source_no") == F.col("_no")) & (F.col("begin") == F.col("_begin")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "begin", "text_key")


def digests(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def repeat_texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as the mix takes them, in whole documents: each pass over a document gives a copy of its row. Blocks are taken
    from the first one on, so a pass that ends at a block's border takes one document of its source in part; that is a copy if
    at least half of its words are taken, so a source's words differ from the mix's by half a document a pass at most. Rows
    equal in id and text share one row, the least as JSON, for all that is taken of them; null ids are told apart by their texts."""
    new = {name: free_name([*docs.columns, "r", "k"], name) for name in ("id", "key", "n", "whole", "pass")}
    mixed = written(mixed, "mixed")
    rounded = F.expr("(2 * taken + size) div (2 * size)")
    some = mixed.filter("2 * taken >= size and size > 0").groupBy(F.col("doc_id").alias(new["id"]), F.col("text_key").alias(new["key"])).agg(F.sum(rounded).alias(new["whole"]))
    # rows that aren't taken count too, so that equal rows are known as such
    times = mixed.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    some = some.join(times, F.col(new["id"]).eqNullSafe(F.col("i")) & F.col(new["key"]).eqNullSafe(F.col("k")), "left").withColumn(new["n"], F.coalesce("times", F.lit(1))).drop("i", "k", "times")
    some, several = written(some, "taken"), not times.isEmpty()
    rows = docs.join(some, F.col(id_col).eqNullSafe(F.col(new["id"])) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(new["key"])))
    if several:
        once, again = rows.filter(F.col(new["n"]) == 1), rows.filter(F.col(new["n"]) > 1)
        every = F.struct(*[F.col(c) for c in rows.columns])
        again = again.groupBy(new["id"], new["key"]).agg(F.min_by(every, F.to_json(every)).alias("r")).select("r.*")
        rows = once.unionByName(again)
    return rows.withColumn(new["pass"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(new["whole"])))).select(*docs.columns)
