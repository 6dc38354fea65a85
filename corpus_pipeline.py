"""Corpus pipeline over `documents`, a module of the pipeline operators at the top of the repository.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Defined results of odd rows are those of the
operators; besides, near_dedup keeps one row a group, known by its id and text, so equal ids on different texts don't meet;
a row with a null id stays only if its group has no id at all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.llm import bpe, hostrules, mixing, pii, shingles, simhash
from quillsieve.llm.common import fresh_path, scratch, table, written
from quillsieve.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the rules, or whose host is rejected, go."""
    return hostrules.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near duplicates (five-word shingles, similarity at least 0.8) the document with the smallest id
    stays. SimHash and its BK-trees give the first links, verified; shingles give those beyond its radius."""
    found = written(shingles.near_duplicates(docs, pairs=simhash.linked_texts(docs)), "near-duplicates")
    # a row is known by its id and text; ids come before no id
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("least")
    stay = found.groupBy("label").agg(least).select(F.col("least.doc_id").alias("_id"), F.col("least.node").alias("_node"))
    times = found.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("_times"))
    stay = stay.join(times, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_node") == F.col("node"))).select("_id", "_node", "_times")
    stay = written(stay, "staying")
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (node == F.col("_node")))
    if stay.filter("_times > 1").isEmpty():
        return named.select(*COLUMNS)
    # rows equal in both may differ in other columns; the least stays, whichever task sees it
    again = named.filter("_times > 1").groupBy("doc_id", "_node").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return named.filter("_times = 1").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def sanitise(spark, docs, sf_dir):
    """Personal data and the terms that disclose it leave the texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """Documents are left out or repeated so that the sources have their target weights."""
    mixed = mixing.mix(docs)
    return mixing.repeat_texts(docs, mixed).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """Ids of every text, and the digest of what they decode to."""
    return bpe.digests(bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("pii", sanitise), ("mixing", mix), ("bpe", encode)]

#: Fingerprints, sanitised texts, the mix and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{k}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
