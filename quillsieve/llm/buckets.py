"""Verified links between the members of buckets, without all pairs of a bucket.

Rows (token, node, size, at) put a node into the bucket of a token. In a bucket of more than `small` members all
meet one head first, the one that lies in most such buckets, so that a group of near copies becomes one component
without its pairs; whoever isn't in the head's component after that meets another head. In the end, members outside
the largest component of a bucket meet all members of other components, and none is left out. Only pairs that
`verify` confirms are links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import written
from quillsieve.llm.simhash import components

#: Members of a bucket up to which they meet in pairs at once.
SMALL = 32
HEADS = 3


def links(live: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Column, enough: Column | None = None, first: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(a, b and what else verify gives): links whose components are those of all verified pairs that share a bucket.
    near and enough: conditions on a_size, b_size and on a_at, b_at of pairs worth verifying. first: pairs (a, b)
    that are verified before."""
    n = live.count()
    found = verify(live.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if first is None else first)
    known = components(found).withColumnRenamed("label", "known")

    def labelled(rows, known):
        return rows.join(known, "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")

    large = written(live.join(live.groupBy("token").count().filter(F.col("count") > small).drop("count"), "token"), "large-buckets", n)
    left = large.join(large.groupBy("node").agg(F.count(F.lit(1)).alias("wide")), "node")
    for _ in range(HEADS):
        if left.isEmpty():
            break
        now = labelled(left, known)
        heads = now.groupBy("token").agg(F.max(F.struct("wide", "node", "size", "label")).alias("head"))
        met = now.join(heads, "token")
        pairs = met.filter("label <> head.label").select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.size").alias("a_size"), F.col("size").alias("b_size")).filter(near)
        more = verify(pairs.select("a", "b"))
        found = written(found.unionByName(more).distinct(), "bucket-links", found.count() + more.count())
        # who is not in the component of the head meets another head
        known = components(found).withColumnRenamed("label", "known")
        after = labelled(met.select("token", "node", "size", "at", "wide"), known)
        tops = labelled(heads.select("token", F.col("head.node").alias("node")), known).select("token", F.col("label").alias("top_label"))
        left = written(after.join(tops, "token").filter("label <> top_label").drop("label", "top_label"), "left-in-buckets", n)
    # members outside the largest component of a bucket meet all members of other components
    rows = written(labelled(live, known), "labelled-buckets", n)
    most = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("kinds"))
    some = rows.join(most.filter("kinds > 1").select("token", F.col("most.label").alias("top")), "token")
    a = some.filter("label <> top").select("token", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("at").alias("a_at"), F.col("label").alias("a_label"))
    b = some.select("token", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("at").alias("b_at"), F.col("label").alias("b_label"), "top")
    once = (F.col("a") < F.col("b")) | (F.col("b_label") == F.col("top"))
    pairs = a.join(b, "token").filter((F.col("a_label") != F.col("b_label")) & once & near & (F.lit(True) if enough is None else enough))
    more = verify(pairs.select("a", "b"))
    return written(found.unionByName(more).distinct(), "bucket-links", found.count() + more.count())
