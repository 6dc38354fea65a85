"""BPE encoding and decoding through a distinct-word table.

Texts are cut into words where byte-level pre-tokenisation always cuts: before a space or newline that
follows a non-space character. A chunk (some millions of characters of one input partition) keeps its
distinct words once, and each text as positions in that list. The words are dealt by hash into buckets;
the task of a bucket encodes every distinct word of it exactly once, and the ids go back to their chunk,
where they are joined to the texts by position. Hot words, sources or copies therefore cost no more than
one entry a chunk, and whole texts never travel.

Decoding joins each id to its piece; the piece table has one row per vocabulary entry, a bound that does
not grow with the data, so the join is made on the map side.

The cutting runs twice (once for words, once for positions), so the input must be deterministic: a table
or a checkpoint. Chunks are named by the input partition, their number in it and the digest of their word list,
so that partitions of equal texts stay apart; an input that changes in between stops with an error instead of
giving wrong ids. There is a bucket for each shuffle partition (`buckets` at least), so that a bucket's words,
which one task keeps while it encodes them, don't grow with the data.

Defined results: null and empty texts give no ids and decode to an empty text; a null id is kept; any column but
the two named ones is ignored; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.llm.common import shuffle_partitions, small_batches, trim

_AWKWARD = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=4)
def special_pattern(path: str):
    """Of the added tokens, found by the driver: tasks that only cut words don't load the vocabulary."""
    found = [t["content"] for t in json.loads(load_tokenizer(path).to_str())["added_tokens"]]
    return re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None


@lru_cache(maxsize=4)
def piece_table(path: str) -> list[bytes]:
    """Bytes of every id. Byte-level vocabularies write byte b as the character of byte_alphabet()[b]."""
    tokenizer = load_tokenizer(path)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    pieces = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return pieces


def byte_alphabet() -> list[str]:
    """Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _plain(text: str) -> bool:
    """No white space before a space or newline, so each of them begins a word."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    if text.isascii():
        return not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    return _AWKWARD.search(text) is None


class _Words:
    """Distinct words in order of first use. A key that follows a cut at a space stands for " " + key."""

    def __init__(self):
        self.words: list[str] = []
        self.after_space: dict[str, int] = {}
        self.literal: dict[str, int] = {}

    def add(self, index: dict[str, int], keys: list[str]) -> None:
        new = [k for k in dict.fromkeys(keys) if k not in index]
        index.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words += new if index is self.literal else [k if k[:1] == "\n" else " " + k for k in new]


def _chunks(batches: Iterator[pa.RecordBatch], special: re.Pattern | None, chunk_chars: int, positions: bool):
    """Yields (doc ids, position arrays if asked for, words); positions into words."""
    found, keys, texts_as, chars = _Words(), [], [], 0
    for batch in small_batches(batches, 200):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if not (special and special.search(text)) and _plain(text):
                first, *rest = text.replace("\n", " \n").split(" ")
                first = [first] if first else []
            else:
                parts = special.split(text) if special else [text]
                first, rest = [x for n, part in enumerate(parts) if part for x in ([part] if n % 2 else _CUT.split(part)) if x], []
            found.add(found.literal, first)
            found.add(found.after_space, rest)
            keys.append(key)
            if positions:
                at = np.empty(len(first) + len(rest), np.int32)
                at[: len(first)] = [found.literal[x] for x in first]
                at[len(first) :] = np.fromiter(map(found.after_space.__getitem__, rest), np.int32, len(rest))
                texts_as.append(_pack(at))
            chars += len(text)
            if chars >= chunk_chars:
                yield keys, texts_as, found.words
                found, keys, texts_as, chars = _Words(), [], [], 0
    if keys:
        yield keys, texts_as, found.words


def _name(number: int, words: list[str]) -> str:
    digest = hashlib.blake2b("\0".join(words).encode(), digest_size=8, salt=len(words).to_bytes(8, "little")).hexdigest()
    task = TaskContext.get()
    return f"{task.partitionId() if task else 0}-{number}-{digest}"


_zip = zstandard.ZstdCompressor(level=1)
_unzip = zstandard.ZstdDecompressor()


def _zipped(data: bytes) -> bytes:
    return _zip.compress(data)


def _unzipped(data: bytes) -> bytes:
    return _unzip.decompress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Byte planes, so that the mostly empty high bytes compress away."""
    return _zip.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _words_of(special: re.Pattern | None, chunk_chars: int, buckets: int):
    def run(batches):
        for number, (_, _, words) in enumerate(_chunks(batches, special, chunk_chars, False)):
            chunk, raw = _name(number, words), [w.encode() for w in words]
            bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets
            order = np.argsort(bucket, kind="stable")
            out = []
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                mine = [raw[i] for i in at.tolist()]
                out.append((chunk, int(bucket[at[0]]), _pack(at), _pack(np.fromiter(map(len, mine), np.uint32, len(mine))), _zipped(b"".join(mine))))
            if not len(order):
                out.append((chunk, 0, b"", b"", b""))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["chunk", "bucket", "places", "lengths", "words"],
            )
        words = raw = out = mine = None
        trim()

    return run


def _positions_of(special: re.Pattern | None, chunk_chars: int):
    def run(batches):
        for number, (keys, texts_as, words) in enumerate(_chunks(batches, special, chunk_chars, True)):
            chunk = _name(number, words)
            for k in range(0, len(keys), 2000):
                part = keys[k : k + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array(texts_as[k : k + 2000], pa.binary())],
                    names=["chunk", "key", "positions"],
                )
        keys = texts_as = words = part = None
        trim()

    return run


def _encode_words(path: str):
    """The rows of one bucket come one after another, so that a word is encoded once and forgotten after."""

    def run(batches):
        tokenizer, known, bucket = load_tokenizer(path), {}, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    known, bucket = {}, row["bucket"]
                if row["places"] == b"":
                    out.append((row["chunk"], b"", b"", b""))
                    continue
                data, ends = _unzipped(row["words"]), np.cumsum(_unpack(row["lengths"])).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                known.update(zip(new, [e.ids for e in tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)]))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                out.append((row["chunk"], row["places"], _pack(sizes), _pack(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "places", "counts", "ids"])
        known = data = words = new = ids = None
        trim()

    return run


def _join_ids(key, texts: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
    if not words.num_rows:
        raise ValueError("the input changed between two reads: a chunk has no words; write it as a table first")
    places, counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for p, c, i in zip(*(words.column(n).to_pylist() for n in ("places", "counts", "ids"))):
        if p:
            places.append(_unpack(p).astype(np.int64))
            counts.append(_unpack(c).astype(np.int64))
            ids.append(_unpack(i).astype(np.int32))
    place, count, flat = np.concatenate(places), np.concatenate(counts), np.concatenate(ids)
    begin, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    starts = np.cumsum(count) - count
    n = int(place.max()) + 1 if len(place) else 0
    begin, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin[place], size[place] = starts, count
    keys, rows = texts.column("key"), texts.column("positions").to_pylist()
    for k in range(0, len(rows), 500):
        at = [_unpack(x).astype(np.int64) for x in rows[k : k + 500]]
        words_at = np.concatenate(at)
        sizes = size[words_at]
        within = np.cumsum(sizes)
        total = int(within[-1]) if len(within) else 0
        out = flat[np.repeat(begin[words_at] - within + sizes, sizes) + np.arange(total)]
        ends = np.concatenate([[0], within])[np.cumsum([0, *map(len, at)])]
        yield pa.RecordBatch.from_arrays([keys.slice(k, 500).combine_chunks(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))], names=["key", "ids"])


def _joined(key, texts: pa.Table, words: pa.Table) -> pa.Table:
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return pa.Table.from_batches([b.cast(schema) for b in _join_ids(key, texts, words)], schema) if texts.num_rows else schema.empty_table()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 12_000_000, buckets: int = 256) -> DataFrame:
    """(id_col, ids): the ids of every whole text, one row per input row."""
    p = shuffle_partitions(docs.sparkSession)
    buckets = max(buckets, p)
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    special = special_pattern(tokenizer_path)
    words = source.mapInArrow(_words_of(special, chunk_chars, buckets), "chunk string, bucket int, places binary, lengths binary, words binary")
    encoded = words.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(tokenizer_path), "chunk string, places binary, counts binary, ids binary")
    positions = source.mapInArrow(_positions_of(special, chunk_chars), "chunk string, key long, positions binary")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    joined = positions.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(lambda k, a, b: _joined(k, a, b), schema)
    return joined.withColumnRenamed("key", id_col)


def _texts(joined: pa.Array) -> pa.Array:
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:  # ids that cut a character
        return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def _decode(pieces: pa.Array):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = part.column(1)
                offsets = pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(ids.flatten())), b"")
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _texts(joined)], names=["key", "ids", "text"])
            ids = joined = part = batch = None
            trim()

    return run


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, text): ids joined to their pieces. Null ids give an empty text."""
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    source = encoded.select(F.col(id_col).cast("long").alias("key"), ids.alias("ids"))
    return source.mapInArrow(_decode(pa.array(piece_table(tokenizer_path), pa.binary())), "key long, ids array<int>, text string").toDF(id_col, ids_col, "text")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decode()'s rows."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
