"""Sharding by histogram sort: shards of nearly equal bytes, equal texts side by side.

Rows sort by a 126-bit key: 63 bits made of the CRC-32 and XXH64 of the text, then 63 bits of the XXH64 of
the id. Splitters are found without sorting: each round counts the exact bytes below evenly spaced probe
keys of the intervals that still hold a wanted boundary (4096 probes an interval), then keeps the one
probe interval that the boundary falls into, until a probe is within `tolerance` of the wanted bytes.
Only rows of kept intervals are read on. Equal texts lie side by side; a boundary that falls into them goes on into the
id part, so copies of one text are split only where a shard ends, whatever their number. Then one exchange deals the rows.

Slots are gapless without a window over a whole shard: rows of a shard go to hash buckets of bounded size,
and a bucket's offset is the sum of the counts before it.

A boundary lies within `tolerance` of a shard from its wanted place, or at the nearer end of the row that it would cut, at any
size of input and of group.

Defined results: a null text has size 8 and CRC 0 and lies with the empty texts; a null id hashes as such;
rows equal in id and text are one indivisible unit, of one bucket, with slots of their own; fewer rows than
shards leave shards empty; a text of any length is one row; an empty table gives an empty result; other columns are
ignored (assign) or carried along whatever their names (write_shards; one named `shard` is written as
`shard_`, since the folders have that name).
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsieve.llm.common import free_name, shuffle_partitions, written

STEP = 12
KEY_BITS = 63


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all of docs), size, text_crc32, _k1 and _k2 (63 bits each)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.shiftleft(crc, 31).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text), 33)).alias("_k1"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(4)), 1).alias("_k2"),
    )


def splitters(rows: DataFrame, n_shards: int, tolerance: float = 0.005) -> list[tuple[int, int]]:
    """Keys (k1, k2) at which shards 1 .. n-1 begin. rows: size, _k1, _k2. The driver holds 4096 counts for each
    boundary and round, whatever the number of rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [total * (i + 1) // n_shards for i in range(n_shards - 1)]
    near = tolerance * total / n_shards
    # an interval: level (0: k1, 1: k2 of one k1), its prefix, bits left below it, bytes before it
    todo = {i: (0, 0, 0, KEY_BITS, 0) for i in range(n_shards - 1)}
    found: dict[int, tuple[int, int]] = {}
    while todo:
        probes: dict[tuple, list[int]] = {}
        for i, (level, k1, prefix, left, before) in todo.items():
            probes.setdefault((level, k1, prefix, left, before), []).append(i)
        after: dict[int, tuple] = {}
        for level, left in sorted({(p[0], p[3]) for p in probes}):
            mine = [p for p in probes if (p[0], p[3]) == (level, left)]
            shift = max(left - STEP, 0)
            key = F.col("_k2" if level else "_k1")
            group = F.col("_k1") if level else F.lit(0).cast("long")
            inside = rows if not level else rows.filter(F.col("_k1").isin([p[1] for p in mine]))
            if left < KEY_BITS:
                inside = inside.filter(F.shiftright(key, left).isin([p[2] for p in mine]))
            counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for r in inside.groupBy(group.alias("g"), F.shiftright(key, shift).alias("probe")).agg(F.sum("size").alias("n")).collect():
                counts.setdefault((r["g"], r["probe"] >> (left - shift)), []).append((r["probe"], r["n"]))
            for p in mine:
                _, k1, prefix, _, before = p
                cells = sorted(counts.get((k1 if level else 0, prefix), []))
                starts = [before]
                for _, n in cells:
                    starts.append(starts[-1] + n)
                for i in probes[p]:
                    want = wanted[i]
                    c = min(max(bisect_right(starts, want) - 1, 0), max(len(cells) - 1, 0))
                    if not cells:
                        found[i] = (k1, prefix << left) if level else (prefix << left, 0)
                        continue
                    probe, n = cells[c]
                    low, high = want - starts[c], starts[c] + n - want
                    at = min(probe << shift if low <= high else (probe + 1) << shift, (1 << 63) - 1)
                    if min(low, high) <= near:
                        found[i] = (k1, at) if level else (at, 0)
                    elif shift:
                        after[i] = (level, k1, probe, shift, starts[c])
                    elif not level:  # one text's copies hold the boundary
                        after[i] = (1, probe, 0, KEY_BITS, starts[c])
                    else:
                        found[i] = (k1, at)
        todo = after
    out = [found[i] for i in range(n_shards - 1)]
    return [max(out[: i + 1]) for i in range(len(out))]


def shard_of(borders: list[tuple[int, int]]) -> Column:
    """Number of borders at or below a row's key."""
    at = [((F.col("_k1") > a) | ((F.col("_k1") == a) & (F.col("_k2") >= b))).cast("int") for a, b in borders]
    return sum(at[1:], at[0]) if at else F.lit(0)


def assign(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.005, rows_per_bucket: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ready = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    rows = written(ready.select("row.doc_id", "size", "text_crc32", "_k1", "_k2"), "shard-keys")
    placed = rows.withColumn("shard", shard_of(splitters(rows, n_shards, tolerance)))
    buckets = max(8, -(-rows.count() // (n_shards * rows_per_bucket)))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("_k2", "_k1"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "_b", (F.sum("n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_k1", "_k2", "doc_id")) - 1
    numbered = placed.withColumn("_place", place).join(before, ["shard", "_b"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes whole rows into shard=<i> folders, dealt once; parts of a shard are cut by hash so no task holds a shard."""
    ready = keyed(docs, id_col, text_col)
    keys = written(ready.select("size", "_k1", "_k2"), "shard-keys")
    p = shuffle_partitions(docs.sparkSession)
    names = [free_name([*docs.columns, "shard"], "shard") if c.lower() == "shard" else c for c in docs.columns]
    salt = F.pmod(F.xxhash64("_k2", "_k1"), F.lit(max(1, -(-p // n_shards))))
    placed = ready.select(*[F.col(f"row.`{c}`").alias(n) for c, n in zip(docs.columns, names)], shard_of(splitters(keys, n_shards, tolerance)).alias("shard"), salt.alias(salted := free_name([*names, "shard"], "salt")))
    placed.repartition(p, "shard", salted).drop(salted).write.partitionBy("shard").parquet(path)
