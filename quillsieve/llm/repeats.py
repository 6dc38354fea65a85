"""Removal of repeated byte strings with a column-wise collection BWT.

A byte goes if it lies in a run of `width` bytes that also begins anywhere else, in any document. Documents
never touch. Only texts cut at content-defined anchors are compared:

1. In each window of `width` bytes the run of `gram` bytes with the smallest hash is its anchor. Equal windows
   have equal anchors at the same offset, so a window can only repeat if its anchor does.
2. The windows of one anchor in a text lie in one piece of at most 2 * width - gram bytes. Pieces whose anchor occurs
   once in distinct texts go no further.
3. Pieces of one anchor meet in one task. Whole groups are packed into collections of bounded bytes, and the
   column-wise construction (colbwt) gives their Burrows-Wheeler transform and common prefixes; a window
   repeats if its suffix shares `width` bytes with a neighbour. Equal pieces count once.
4. An anchor of more than `most` places (a passage that very many documents share) would be too large a group.
   Its equal pieces become one kind. Where there are still more than `most` kinds, the windows are halved by
   where the anchor lies in them: all windows of a half hold the same longer stretch of bytes around it, which
   is the key of smaller groups. Halving ends with groups of at most `most` kinds (one window each, at the
   latest), which go through the same construction.
5. The runs found go back to their texts. A text that occurs twice is removed as a whole.

The construction over a whole corpus needs as many rounds as the longest text has bytes, each a pass over
everything inserted so far; the anchors bound both, and lose no window. External files of a round are arrays
of one collection in memory, since executors share no local folder.

Texts are known by 96 bits of XXH64, so copies cost no more than their scan. A bit map of fixed size
(`bits`) tells most texts without a piece from those with one, so that only the latter move; where it fills
up more texts move and results stay the same.

Defined results: a null or empty text has no bytes; texts shorter than width never change; a null id is kept;
repeated rows are equal texts and repeat each other; a text of any length is scanned in parts; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.colbwt import repeated, window_hashes
from quillsieve.llm.common import BitMap, release, shuffle_partitions, written

PART = 1 << 19
PLACE_BITS = 21
BATCH = 150_000


def anchors(data: np.ndarray, width: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(hash, first, last, place): the windows first .. last have the anchor of that hash, which begins at `place`.
    Each window once."""
    out: list[tuple[int, int, int, int]] = []
    n = len(data) - width + 1
    for begin in range(0, max(n, 0), PART):
        part = data[begin : min(begin + PART, n) + width - 1]
        hashes = window_hashes(part, gram)
        key = (hashes & np.uint64((1 << 64) - (1 << PLACE_BITS))) | np.arange(len(hashes), dtype=np.uint64)
        span, size = width - gram + 1, 1
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
        at = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        places = at[cut[:-1]]
        out += zip(hashes[places].view(np.int64).tolist(), (begin + cut[:-1]).tolist(), (begin + cut[1:] - 1).tolist(), (begin + places).tolist())
    return out


def _anchor_rows(width: int, gram: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = [[], [], [], [], [], []]
                for t1, t2, text in zip(*(batch.column(c).slice(k, 500).to_pylist() for c in range(3))):
                    found = anchors(np.frombuffer(text.encode(), np.uint8), width, gram)
                    for column, values in zip(rows, (*zip(*found), [t1] * len(found), [t2] * len(found)) if found else ()):
                        column.extend(values)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["anchor", "first", "last", "place", "t1", "t2"])

    return run


def _pieces(width: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                out = []
                for row in batch.slice(k, 200).to_pylist():
                    data, places = row["text"].encode(), {}
                    for p in row["pieces"]:  # a text that repeats itself gives each piece once, with its places
                        places.setdefault((p["anchor"], p["hot"], p["place"] - p["first"], data[p["first"] : p["last"] + width]), []).append(p["first"])
                    out += [(anchor, hot, row["t1"], row["t2"], sorted(firsts), piece, at) for (anchor, hot, at, piece), firsts in places.items()]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=["anchor", "hot", "t1", "t2", "firsts", "piece", "at"])

    return run


def _runs(marks: np.ndarray, first: int, width: int) -> list[int]:
    """Begin and end of the byte runs that marked windows cover, one after another."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return [int(x) for a, b in zip(edges[::2], edges[1::2]) for x in (first + a, first + b - 1 + width)]


_RUNS = pa.schema([("t1", pa.int64()), ("t2", pa.int32()), ("runs", pa.list_(pa.int32()))])


def _compare(width: int, batch_bytes: int):
    """Rows come sorted by anchor. Groups are whole: at most `most` places of pieces."""

    def run(batches):
        todo: list[tuple[bytes, dict]] = []
        group: dict[bytes, dict] = {}  # piece -> text -> its places there

        def twice(where):
            return len(where) > 1 or any(len(firsts) > 1 for firsts in where.values())
        anchor, size = None, 0

        def close():
            nonlocal size
            if len(group) > 1:
                todo.extend(group.items())
                size += sum(map(len, group))
            else:
                todo.extend((piece, where) for piece, where in group.items() if twice(where))
            group.clear()

        def flush():
            nonlocal size
            out = []
            for (piece, where), marks in zip(todo, repeated([piece for piece, _ in todo], width)):
                if twice(where):
                    marks[:] = True
                if marks.any():
                    runs = _runs(marks, 0, width)
                    out += [(t1, t2, [first + x for first in firsts for x in runs]) for (t1, t2), firsts in where.items()]
            todo.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, _RUNS)], schema=_RUNS)

        for batch in batches:
            for a, t1, t2, firsts, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    close()
                    anchor = a
                    if size >= batch_bytes:
                        yield flush()
                group.setdefault(piece, {})[(t1, t2)] = firsts
        close()
        if todo:
            yield flush()

    return run


def halves(piece: bytes, at: int, low: int, high: int, width: int):
    """The windows of a piece (anchor at byte `at` of it) in which the anchor lies at byte low .. high, in two parts:
    (first window, part, its low and high, the bytes that all windows with this anchor and range hold)."""
    n, middle = len(piece) - width + 1, (low + high + 1) // 2
    for a, b in ((low, middle - 1), (middle, high)):
        first, last = max(at - b, 0), min(at - a, n - 1)
        if a <= b and first <= last:
            yield first, piece[first : last + width], a, b, piece[at - a : at - b + width]


_SPLIT = "key long, n1 long, n2 int, piece binary, at int, low int, high int, k1 long, k2 int, off int, twice boolean"


def _halved(width: int):
    def run(batches):
        names = [c.split()[0] for c in _SPLIT.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]] for c in _SPLIT.split(", ")]
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for row in batch.slice(k, 500).to_pylist():
                    for first, part, a, b, core in halves(row["piece"], row["at"], row["low"], row["high"], width):
                        key = digest(b"%d:%d:%d:" % (row["key"], a, b) + core)
                        named = b"%d:%d:" % (key, row["at"] - first) + part
                        out.append((key - (1 << 63), digest(named) - (1 << 63), digest(named, 7) >> 33, part, row["at"] - first, a, b, row["k1"], row["k2"], first, row["twice"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    return run


def hot_runs(pieces: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """(t1, t2, runs) of the pieces of hot anchors, through groups of at most `most` kinds of equal pieces."""
    p = shuffle_partitions(pieces.sparkSession)
    named = pieces.withColumns({"k1": F.xxhash64("anchor", "piece"), "k2": F.expr("cast(xxhash64(7, anchor, piece) & 2147483647 as int)")})
    named = written(named.select("anchor", "k1", "k2", "t1", "t2", "firsts", "piece", "at"), "hot-pieces")
    text = F.xxhash64("t1", "t2")
    kinds = named.groupBy("k1", "k2").agg(F.max("anchor").alias("key"), F.max("piece").alias("piece"), F.max("at").alias("at"), F.min(text).alias("a"), F.max(text).alias("b"), F.max(F.size("firsts")).alias("n"))
    kinds = kinds.select("key", "k1", "k2", "piece", "at", F.lit(0).alias("low"), F.lit(width - gram).alias("high"), ((F.col("a") != F.col("b")) | (F.col("n") > 1)).alias("twice"))
    kinds = written(kinds, "hot-kinds")
    # where a kind of this round lies in the kinds of the first one
    lies = kinds.select("k1", "k2", F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.lit(0).alias("off"))
    out = None
    while True:
        sizes = written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("again")).filter("n > 1 or again").select("key", (F.col("n") > most).alias("large")), "hot-groups")
        sized = kinds.join(sizes, "key")
        # a kind that lies in several places has two places in its group
        small = sized.filter("not large").select("key", "k1", "k2", F.expr("if(twice, array(0, 0), array(0))").alias("firsts"), "piece")
        found = small.repartition(p, "key").sortWithinPartitions("key").mapInArrow(_compare(width, BATCH), "t1 long, t2 int, runs array<int>")
        found = written(found.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "runs"), "hot-found")
        moved = found.join(lies, ["k1", "k2"]).select("r1", "r2", F.transform("runs", lambda x: x + F.col("off")).alias("runs"))
        out = moved if out is None else out.unionByName(moved)
        if sizes.filter("large").isEmpty():
            break
        parts = written(sized.filter("large").drop("large").mapInArrow(_halved(width), _SPLIT), "hot-halves")
        where = F.xxhash64("k1", "k2", "off")
        kinds = parts.groupBy("n1", "n2").agg(*[F.max(c).alias(c) for c in ("key", "piece", "at", "low", "high", "twice")], F.min(where).alias("a"), F.max(where).alias("b"))
        kinds = written(kinds.select("key", F.col("n1").alias("k1"), F.col("n2").alias("k2"), "piece", "at", "low", "high", (F.col("twice") | (F.col("a") != F.col("b"))).alias("twice")), "hot-kinds")
        inner = parts.select("k1", "k2", "n1", "n2", F.col("off").alias("more")).join(lies, ["k1", "k2"])
        lies = written(inner.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), "r1", "r2", (F.col("off") + F.col("more")).alias("off")), "hot-lies")
    runs = written(out, "hot-runs")
    places = named.select("k1", "k2", "t1", "t2", "firsts").join(runs, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")))
    return places.select("t1", "t2", F.flatten(F.transform("firsts", lambda first: F.transform("runs", lambda x: x + first))).alias("runs"))


def _cut(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            out = []
            for key, text, twice, runs in zip(*(c.slice(k, 500).to_pylist() for c in batch.columns)):
                data = text.encode()
                ordered = [(0, len(data))] if twice else sorted((r[i], r[i + 1]) for r in runs or [] for i in range(0, len(r), 2))
                merged: list[list[int]] = []
                for a, b in ordered:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out.append((key, len(data), sum(b - a for a, b in merged), len(merged), b"".join(kept)))
            kinds = (*[pa.int64()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=names)


def remove(docs: DataFrame, width: int = 400, gram: int = 128, most: int = 4096, bits: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay, which may cut characters)."""
    p = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    source = source.withColumns({"t1": F.xxhash64("text"), "t2": F.expr("cast(xxhash64(7, text) & 2147483647 as int)")})
    long = F.octet_length("text") >= width

    texts = written(source.filter(long).groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "texts")
    rows = source.filter(long).select("t1", "t2", "text").mapInArrow(_anchor_rows(width, gram), "anchor long, first int, last int, place int, t1 long, t2 int")
    rows = written(rows, "anchors")
    place = F.xxhash64("t1", "t2", "first")
    # sums by anchor are tables before they are joined, so that a frequent anchor's rows can be split over tasks
    again = written(rows.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("anchor"), "repeated-anchors")
    held = written(rows.join(again, "anchor", "left_semi"), "held-anchors")
    for done in (rows, again):
        release(done)
    # copies count in the first number only; the few anchors above it are counted without them
    often = written(held.groupBy("anchor").count().filter(F.col("count") > most).select("anchor"), "frequent-anchors")
    places = held.join(often, "anchor", "left_semi").select("t1", "t2", "first", "anchor").distinct()
    hot = written(places.groupBy("anchor").count().filter(F.col("count") > most).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    any_hot = not hot.isEmpty()
    flagged = held.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else held.withColumn("hot", F.lit(False))
    lists = flagged.groupBy("t1", "t2").agg(F.collect_set(F.struct("anchor", "hot", "first", "last", "place")).alias("pieces"))  # bounded by the text; copies fall together
    lists = written(lists.join(texts, ["t1", "t2"]).select("t1", "t2", "rep", "pieces"), "piece-lists")
    release(held)

    near = BitMap(lists, "t1", bits)
    having = source.filter(long).filter(near.column("t1"))
    joined = having.join(lists.withColumnRenamed("t1", "_1").withColumnRenamed("t2", "_2"), (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    pieces = joined.select("t1", "t2", "text", "pieces").mapInArrow(_pieces(width), "anchor long, hot boolean, t1 long, t2 int, firsts array<int>, piece binary, at int")
    if any_hot:
        pieces = written(pieces, "pieces")
    cold = pieces.filter("not hot").select("anchor", "t1", "t2", "firsts", "piece")
    runs = cold.repartition(p, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare(width, BATCH), "t1 long, t2 int, runs array<int>")
    if any_hot:
        runs = runs.unionByName(hot_runs(pieces.filter("hot"), width, gram, most))
    found = runs.groupBy("t1", "t2").agg(F.collect_list("runs").alias("runs"), F.lit(False).alias("twice"))  # bounded by the text
    copied = texts.filter("n > 1").select("t1", "t2", F.lit(None).cast("array<array<int>>").alias("runs"), F.lit(True).alias("twice"))
    single = found.join(copied.select("t1", "t2"), ["t1", "t2"], "left_anti")
    found = written(single.unionByName(copied), "runs")

    cut = BitMap(found, "t1", bits)
    changed = source.filter(long).withColumn("_maybe", cut.column("t1"))
    hit = changed.filter("_maybe").join(found, ["t1", "t2"], "left").select("doc_id", "text", F.coalesce("twice", F.lit(False)).alias("twice"), "runs")
    hit = hit.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    rest = changed.filter("not _maybe").select("doc_id", "text").unionByName(source.filter(~long).select("doc_id", "text"))
    zero = F.lit(0).cast("long")
    return hit.unionByName(rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept")))


def digests(removed: DataFrame) -> DataFrame:
    """The kept bytes also as `text`; bytes of characters that a cut went through become U+FFFD there."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
