"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

all pairwise interactions in time linear in the number of features. Inputs are the words (hashed into
`BUCKETS`, damped and normalised), statistics of the text's structure, each as a value and as a bin, and
the document's recorded length. Labels, language, source and id are never inputs.

The machine is fitted on the driver on at most `max_train` labelled ids, chosen by hash, and of these on as many,
in order of that hash, as have `max_features` features together; these bounds are its one sample. Every row is
scored, from its whole text.

Defined results: null and empty texts have structure features only and get a score like any other; a null
id is scored and never trained on; several labels of one id count as their smallest, and of several texts of one id
one is trained on, the least; ties of the hash go by id; a text of any length has one feature a distinct word; without two
classes of labels every score is the share of the one there is (0.5 without labels); repeated rows get equal scores;
an empty table gives an empty result; columns but the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsieve.llm.common import written

BUCKETS = 1 << 14
BINS = 8
STATS = 14
SIZE = BUCKETS + STATS * (BINS + 1) + 34
_known: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _known.get(word)
    if found is None:
        if len(_known) > 400_000:
            _known.clear()
        found = _known[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
    return found


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Numbers from 0 to 1."""
    n, chars = max(len(words), 1), max(len(text), 1)
    raw = text.encode("utf-8", "replace")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    total = max(len(raw), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    upper, lower, digits = byte[65:91].sum(), byte[97:123].sum(), byte[48:58].sum()
    marks = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
    return [
        min(np.log1p(len(words)) / 12, 1), min(np.log1p(len(text)) / 14, 1), min((chars - n) / n / 20, 1), upper / max(upper + lower, 1),
        min(10 * digits / total, 1), min(4 * marks / total, 1), len(counts) / n, max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(len(lines), 1), min(np.log1p(chars / max(len(lines), 1)) / 10, 1), runs / n, pairs / n,
        min(20 * byte[list(b"#*$%&|<>{}[]=_~^")].sum() / total, 1), min(8 * (byte[33] + byte[63]) / total, 1),
    ]


def features(text: str | None, recorded: int | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or ""
    words = text.split()
    counts = Counter(words)
    at = [_bucket(w) for w in counts]
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    value /= max(np.sqrt((value**2).sum()), 1e-9)
    stats = np.array(statistics(text, words, counts))
    first = BUCKETS
    at += range(first, first + STATS)
    bins = np.minimum((stats * BINS).astype(int), BINS - 1)
    at += (first + STATS + np.arange(STATS) * BINS + bins).tolist()
    meta = first + STATS * (BINS + 1)
    at.append(meta + (33 if recorded is None else min(max(int(recorded), 0).bit_length(), 32)))
    return np.array(at, np.int32), np.concatenate([value, stats, np.ones(STATS + 1)]).astype(np.float32)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class Machine:
    def __init__(self, rank: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(SIZE, np.float32)
        self.v = rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32)

    def margin(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray):
        x = value[:, None] * self.v[at]
        sums = _sums(x, starts)
        return self.bias + _sums(value * self.w[at], starts) + 0.5 * (sums**2 - _sums(x**2, starts)).sum(axis=1), x, sums

    def score(self, at, value, starts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(at, value, starts)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, batch: int = 128, shrink: float = 1e-5, seed: int = 6) -> Machine:
        share = float(labels.mean()) if len(labels) else 0.5
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not len(labels) or not 0 < share < 1:
            self.v[:] = 0
            return self
        rng = np.random.default_rng(seed)
        g_w, g_v, g_b = np.full(SIZE, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                mine = order[k : k + batch]
                sizes = np.array([len(rows[i][0]) for i in mine])
                at, value = np.concatenate([rows[i][0] for i in mine]), np.concatenate([rows[i][1] for i in mine])
                starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(mine)), sizes)
                margin, x, sums = self.margin(at, value, starts)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[mine]).astype(np.float32) / len(mine)
                down_w = slope[of] * value
                down_v = down_w[:, None] * (sums[of] - x)
                sort = np.argsort(at, kind="stable")
                ids, first = np.unique(at[sort], return_index=True)
                d_w = _sums(down_w[sort], first) + shrink * self.w[ids]
                d_v = _sums(down_v[sort], first) + shrink * self.v[ids]
                g_w[ids] += d_w**2
                g_v[ids] += d_v**2
                self.w[ids] -= rate * d_w / np.sqrt(g_w[ids])
                self.v[ids] -= 0.3 * rate * d_v / np.sqrt(g_v[ids])
                d_b = float(slope.sum())
                g_b += d_b**2
                self.bias -= rate * d_b / g_b**0.5
        return self


def _features_of(batches):
    for batch in batches:
        rows = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        made = [pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([*made, batch.column(3), batch.column(4), batch.column(0)], names=["at", "value", "label", "place", "doc_id"])


def _inputs(docs: DataFrame, id_col: str, text_col: str, length_col: str | None):
    length = F.col(length_col).cast("long") if length_col and length_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), length.alias("n"))


def is_held_out(doc_id):
    """crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, max_features: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", label_col: str = "quality") -> Machine:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = known.withColumn("place", F.xxhash64("doc_id", F.lit(2))).orderBy("place", "doc_id").limit(max_train)
    rows = _inputs(docs, id_col, text_col, length_col).join(F.broadcast(sample), "doc_id")  # at most max_train rows
    # one text an id: rows of an id meet as digests, and equal ones are one
    rows = rows.withColumn("digest", F.xxhash64("text", "n"))
    least = F.broadcast(rows.groupBy("doc_id").agg(F.min("digest").alias("digest")))
    rows = rows.join(least, ["doc_id", "digest"]).dropDuplicates(["doc_id"])
    made = rows.select("doc_id", "text", "n", "label", "place").mapInArrow(_features_of, "at binary, value binary, label int, place long, doc_id long")
    made = written(made, "training-rows")
    order = Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most max_train rows
    within = made.select("doc_id", F.sum(F.octet_length("at") / 4).over(order).alias("so_far")).filter(F.col("so_far") <= max_features)
    found = made.join(F.broadcast(within), "doc_id").collect()  # the bounded sample
    found.sort(key=lambda r: (r["at"], r["value"], r["label"]))  # so that no order of tasks matters
    data = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found]
    return Machine().fit(data, np.array([float(r["label"] > 0) for r in found], np.float32))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """(id_col, score) of every row."""

    def run(batches):
        for batch in batches:
            keys, texts, lengths = (batch.column(k) for k in range(3))
            for k in range(0, batch.num_rows, 500):
                rows = [features(t, n) for t, n in zip(texts.slice(k, 500).to_pylist(), lengths.slice(k, 500).to_pylist())]
                sizes = np.array([len(a) for a, _ in rows])
                out = machine.score(np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([keys.slice(k, 500), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return _inputs(docs, id_col, text_col, length_col).mapInArrow(run, "doc_id long, score double").withColumnRenamed("doc_id", id_col)


def digests(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
