"""Document fingerprints by randomised edit embedding.

A shared random walk copies the characters of a text: at step j it writes the character it stands on and
moves on by one if the shared bit of (j, character) is set. Texts a few edits apart fall into step again
soon after each edit, so their edit distance becomes a Hamming distance of what was written. The
fingerprint samples what was written: `PER_OCTAVE` samples of the first steps and as many of each doubling
after that, at places that are the same for all texts. A sample is one hexadecimal digit, 0 once the text
has ended. likeness() weighs each sample by the steps it stands for.

Texts walk in lock-step through numpy, some million characters at a time; memory is bounded by the batch.

near_pairs() groups fingerprints by bands of bit-sampled digits of octaves before the last and links the members
of a band by verified likeness (buckets.links); copies count once. near_groups() gives their components. Openings that
very many short texts share make bands whose unlike members meet in pairs, so its work can grow faster than the input.

Defined results: a null text is an empty one (fingerprint of zeros, likeness 1 to another empty text); a
null id sorts last; equal ids go by the XXH64 of their texts; repeated rows follow each other; other columns are ignored; an
empty table gives an empty result. The only document of a table is its own next one. A group has no id if no
document of it has one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm import buckets
from quillsieve.llm.common import BitMap, shuffle_partitions, small_batches, written
from quillsieve.llm.simhash import components

SEED = 20240229
PERIOD = 4096
PER_OCTAVE = 32
FEW = 6
#: Bits of the map that tells most bands of one fingerprint from shared ones.
BITS = 1 << 24
_BACK = bytes.maketrans(b"0123456789abcdef", bytes(range(16)))


@lru_cache(maxsize=1)
def _bits() -> np.ndarray:
    bits = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256)).astype(np.uint8)
    bits[:, 0] = 0  # the end of a text holds the walk
    return bits


@lru_cache(maxsize=1)
def _bit_rows() -> list[bytes]:
    return [row.tobytes() for row in _bits()]


@lru_cache(maxsize=64)
def _octave(k: int) -> tuple[list[int], int]:
    """Sampled steps of an octave, and the steps that each stands for."""
    if k == 0:
        return list(range(PER_OCTAVE)), 1
    stride = 1 << (k - 1)
    shift = np.random.default_rng([SEED, k]).integers(0, stride, PER_OCTAVE)
    return (PER_OCTAVE * stride + np.arange(PER_OCTAVE) * stride + shift).tolist(), stride


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = points * np.uint32(0x9E3779B1)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77)
    out = np.zeros(len(points) + 1, np.uint8)
    out[:-1] = 1 + (mixed >> np.uint32(16)) % np.uint32(255)
    return out


@lru_cache(maxsize=1)
def _digits() -> np.ndarray:
    """Digit 1 to 15 of each class of characters, 0 for the end."""
    digits = np.random.default_rng(SEED + 1).integers(1, 16, 256).astype(np.uint8)
    digits[0] = 0
    return digits


def walk(texts: list[str]) -> list[bytes]:
    """Samples of each text, one byte a sample, whole octaves, trailing empty octaves cut."""
    if not texts:
        return []
    parts = [_classes(t) for t in texts]
    chars = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    at = (np.cumsum(sizes) - sizes).astype(np.int64)
    bits, digit, alive = _bits(), _digits(), np.arange(len(texts))
    columns: list[np.ndarray] = []
    octave, step = 0, 0
    while True:
        sampled, stride = _octave(octave)
        taken = np.zeros((len(texts), PER_OCTAVE), np.uint8)
        todo = iter(enumerate(sampled))
        k, due = next(todo)
        end = PER_OCTAVE << octave
        if len(alive) <= FEW:
            rows, raw = _bit_rows(), None
            for n, i in enumerate(alive.tolist()):
                raw, p, j = chars, int(at[n]), step
                data = raw[p : int(at[n]) + end - step + 1].tobytes()
                q = 0
                for k, due in enumerate(sampled):
                    while j < due:
                        q += rows[j & 4095][data[q]]
                        j += 1
                    taken[i, k] = digit[data[q]]
                while j < end:
                    q += rows[j & 4095][data[q]]
                    j += 1
                at[n] = p + q
            step = end
        else:
            while step < end:
                c = chars[at]
                if step == due:
                    taken[alive, k] = digit[c]
                    k, due = next(todo, (0, -1))
                at += bits[step & 4095][c]
                step += 1
                if not step & 127:
                    live = chars[at] != 0
                    if live.sum() < 0.8 * len(live):
                        alive, at = alive[live], at[live]
        live = chars[at] != 0
        alive, at = alive[live], at[live]
        columns.append(taken)
        octave += 1
        if not len(alive):
            break
    table = np.concatenate(columns, axis=1)
    out = []
    for row in table:
        last = np.flatnonzero(row)
        octaves = 1 if not len(last) else 1 + int(last[-1]) // PER_OCTAVE
        out.append(row[: octaves * PER_OCTAVE].tobytes())
    return out


_HEX = bytes.maketrans(bytes(range(16)), b"0123456789abcdef")


def fingerprint_text(samples: bytes) -> str:
    return samples.translate(_HEX).decode()


def likeness(a: bytes, b: bytes) -> float:
    """Weighted share of equal samples among those where either text goes on; 1 for two empty texts."""
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, b"\0"), np.uint8) for s in (a, b))
    weight = np.repeat([_octave(k)[1] for k in range(n // PER_OCTAVE)], PER_OCTAVE)
    either = (x | y) != 0
    total = weight[either].sum()
    return float(weight[either & (x == y)].sum() / total) if total else 1.0


def _dealt(borders: list[tuple]):
    """(code, doc_id, hash, packed text): code is 2 * the bucket, and the first rows of a bucket also go to the bucket
    before, with 2 * that + 1. borders: the least (no id, id, hash of the text) of each bucket, in order."""
    n = len(borders)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in small_batches(batches):
            out = []
            for key, h, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                place = (key is None, key or 0, h)
                b, packed = max(bisect_right(borders, place) - 1, 0), pack.compress((text or "").encode())
                out.append((2 * b, key, h, packed))
                if n > 1 and borders[b] == place:
                    out.append((2 * ((b - 1) % n) + 1, key, h, packed))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["code", "doc_id", "hash", "packed"])

    return run


def _pairs(batches):
    """(id, text, text of the next document) in order; rows come sorted by bucket, those of the next bucket last."""
    bucket, first, last, closed = None, None, None, False
    unpack = zstandard.ZstdDecompressor()
    for batch in small_batches(batches):
        for code, key, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
            text = unpack.decompress(packed).decode()
            if code >> 1 != bucket:
                if last and not closed:
                    yield (*last, first[1])
                bucket, first, last, closed = code >> 1, None, None, False
            if closed:
                continue
            if last:
                yield (*last, text)
            if code & 1:
                closed = True
                continue
            last = (key, text)
            first = first or last
    if last and not closed:
        yield (*last, first[1])


def edited(text: str, other: str) -> str:
    """The last half of the characters (rounded down) replaced by the first as many of the other text."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def _prints(batch_chars: int):
    def finish(rows):
        texts = list(dict.fromkeys(x for _, t, nxt in rows for x in (t, edited(t, nxt), nxt)))
        known = dict(zip(texts, walk(texts)))
        out = []
        for key, text, after in rows:
            change = edited(text, after)
            a, b = known[text], known[change]
            out.append((key, len(text), hashlib.sha256(change.encode()).hexdigest(), fingerprint_text(a), fingerprint_text(b), likeness(a, b), likeness(a, known[after])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        rows, chars = [], 0
        for row in _pairs(batches):
            rows.append(row)
            chars += len(row[1])
            if chars >= batch_chars:
                yield finish(rows)
                rows, chars = [], 0
        if rows:
            yield finish(rows)

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document, and their likeness.

    Texts move once, packed, into buckets of neighbouring documents; the first document of a bucket also goes to
    the bucket before it, where it is the next one of the last."""
    p = shuffle_partitions(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text.alias("text"))
    place = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("hash")]
    ranged = source.select(*[c.alias(n) for c, n in zip(place, ("none", "id", "hash"))]).repartitionByRange(4 * p, "none", "id", "hash")
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("none", "id", "hash")).alias("first")).collect()  # one a partition
    borders = sorted(tuple(r["first"]) for r in firsts)
    dealt = source.mapInArrow(_dealt(borders), "code int, doc_id long, hash long, packed binary").withColumn("bucket", F.shiftright("code", 1))
    dealt = dealt.repartition(p, "bucket").sortWithinPartitions("code", F.col("doc_id").asc_nulls_last(), "hash")
    return dealt.select("code", "doc_id", "packed").mapInArrow(_prints(batch_chars), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _banded(nodes: DataFrame, bands: int, digits: int) -> DataFrame:
    """(token, node): hashes of `digits` sampled digits, `bands` times in each of the two octaves before the last; the
    last one is cut short by the text's end, and lengths about a power of two share one of the others."""
    rng = np.random.default_rng(SEED)
    kept = F.array(*[F.array(*[F.lit(i + 1) for i in sorted(rng.choice(PER_OCTAVE, digits, replace=False).tolist())]) for _ in range(bands)])
    octave = lambda back: F.greatest(F.lit(0), F.floor(F.length("print") / PER_OCTAVE) - back).cast("int")
    parts = [F.struct(octave(back).alias("octave"), F.substring("print", octave(back) * PER_OCTAVE + 1, F.lit(PER_OCTAVE)).alias("piece")) for back in (2, 3)]
    sampled = nodes.select("node", F.explode(F.array_distinct(F.array(*parts))).alias("p")).select("node", "p.octave", "p.piece")
    keys = F.transform(kept, lambda places, band: F.xxhash64(F.col("octave"), band, F.concat_ws("", F.transform(places, lambda i: F.substring("piece", i, F.lit(1))))))
    return sampled.select("node", F.explode(keys).alias("token"))


def _alike(least: float):
    def run(batches):
        for batch in small_batches(batches):
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            found = [(i, j, alike) for i, j, p, q in zip(a, b, x, y) if (alike := likeness(p.encode().translate(_BACK), q.encode().translate(_BACK))) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "likeness"])

    return run


def _near_nodes(prints: DataFrame, least: float, bands: int, digits: int, id_col: str, print_col: str, small: int) -> tuple[DataFrame, DataFrame]:
    """(node, id) of the distinct fingerprints, and verified links (a, b, likeness) of nodes. Only nodes that share a band
    move with their fingerprints."""
    named = prints.select(F.xxhash64(print_col).alias("node"), F.col(print_col).alias("print"), F.col(id_col).alias("id"))
    nodes = written(named.groupBy("node").agg(F.min("id").alias("id")), "prints")
    banded = _banded(named, bands, digits)
    # copies count too here; they fall together after the few rows left have moved
    again = written(banded.groupBy("token").count().filter("count > 1").select("token"), "shared-bands")
    some = written(BitMap(again, "token", BITS).keep(banded, "token").join(again, "token", "left_semi").distinct(), "band-rows")
    shared = some.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("token")
    live = written(some.join(written(shared, "bands"), "token", "left_semi").select("token", "node", F.lit(0).alias("size"), F.lit(0).alias("at")), "band-members")
    texts = named.join(live.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("print").alias("print"))
    texts = written(texts, "band-prints")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("print").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("print").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long, likeness double"), "alike")

    return nodes, buckets.links(live, verify, F.lit(True), small=small)


def near_pairs(prints: DataFrame, least: float = 0.8, bands: int = 14, digits: int = 9, id_col: str = "doc_id", print_col: str = "fingerprint", small: int = buckets.SMALL) -> DataFrame:
    """(a, b, likeness): pairs of smallest ids of equal fingerprints that share a band of bit-sampled digits. They
    connect all members of a band whose likeness, verified on the whole fingerprints, is at least `least`."""
    nodes, links = _near_nodes(prints, least, bands, digits, id_col, print_col, small)
    named = nodes
    both = links.join(named.withColumnsRenamed({"node": "a", "id": "x"}), "a").join(named.withColumnsRenamed({"node": "b", "id": "y"}), "b")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def near_groups(prints: DataFrame, least: float = 0.8, bands: int = 14, digits: int = 9, id_col: str = "doc_id", print_col: str = "fingerprint", small: int = buckets.SMALL) -> DataFrame:
    """prints with near_id, the smallest id that a document reaches over equal fingerprints and verified pairs, and
    n_near, the number of distinct fingerprints of that group."""
    nodes, links = _near_nodes(prints, least, bands, digits, id_col, print_col, small)
    labels = components(links)
    named = nodes.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    groups = named.groupBy("label").agg(F.min("id").alias("near_id"), F.count(F.lit(1)).alias("n_near"))
    found = named.join(groups, "label").select("node", "near_id", "n_near")
    return prints.join(found, F.xxhash64(print_col) == F.col("node")).select(*prints.columns, "near_id", "n_near")
