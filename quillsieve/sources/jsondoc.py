"""One JSON document of any size, read by many tasks, and written by many.

The text source cuts files into byte ranges at commas. What a range means depends on where it begins: inside a string or
not, how deep, under which keys. Each range is first summed up for both beginnings (whether it ends inside a string, how
many containers it closes and opens, under which keys, and how many elements begin at each depth below its own). These
sums, one row a range, are put one after the other, so each range knows its beginning; then it is read again and gives
its elements at the depth asked for. An element that lies in several ranges comes as parts that are joined; no
row grows with the document.

Defined results: files of a folder are one document, in order of their names, none of which ends in a comma; an empty document or container gives no
elements; elements keep their text, numbers and escapes as they are; a depth that the document doesn't reach gives none;
text that isn't JSON gives an error where its brackets don't match. A key that holds a comma may not be that of a
container above the elements if a range begins inside it: that is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}\[\]:]', re.S)
_CLOSE = re.compile(r'(?:[^"\\]|\\.)*?"', re.S)
_TURN = re.compile(r"[{}\[\]\\]")
_SUM = "file string, start long, inside boolean, ends_inside boolean, closed int, opened array<string>, begun map<int,long>"
_PART = "file string, start long, at long, element long, whole boolean, path array<string>, text string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep=",").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, start, pieces) of each range in a task's rows, in order; the pieces must be used up."""
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3))))
    ahead = next(rows, None)

    def pieces(file, start):
        nonlocal ahead
        while ahead is not None and ahead[1:] == (file, start):
            yield ahead[0]
            ahead = next(rows, None)

    while ahead is not None:
        yield ahead[1], ahead[2], pieces(*ahead[1:])


class _Walk:
    """Place in a document: keys of the open containers (null in arrays and at the top, empty if unknown), whether in a string."""

    def __init__(self, inside: bool, keys: list[str | None]):
        self.inside, self.keys, self.closed, self.key = inside, keys, 0, None
        self.string: list[str] | None = None  # the string that is open; null if it began before the range

    def steps(self, piece: str) -> Iterator[tuple[int, str]]:
        """(place behind it, bracket) of the brackets of a piece outside strings; `keys` and `closed` follow."""
        at, said = 0, None
        quotes = piece.count('"')
        if not quotes % 2 and not _TURN.search(piece):  # without brackets and escapes it ends as it began; its key ends with it
            if self.inside and quotes:
                self.string = [piece[piece.rfind('"') :]]
            elif self.inside and self.string is not None:
                self.string.append(piece)
            return
        if self.inside:
            end = _CLOSE.match(piece)
            if self.string is not None:
                self.string.append(piece[: end.end()] if end else piece)
            if not end:
                return
            self.inside, at, said = False, end.end(), "" if self.string is None else ",".join(self.string)
        for m in _TOKEN.finditer(piece, at):
            token = m[0]
            if token[0] == '"':
                if not _CLOSE.fullmatch(token, 1):
                    self.inside, self.string = True, [token]
                    return
                said = token
            elif token == ":":
                self.key = said
            else:
                if token in "{[":
                    self.keys.append(self.key)
                elif self.keys:
                    self.keys.pop()
                else:
                    self.closed += 1
                self.key = None
                yield m.end(), token


def _summed(batches):
    rows = []
    for file, start, pieces in _ranges(batches):
        both = [(_Walk(inside, []), {}) for inside in (False, True)]
        for k, piece in enumerate(pieces):
            for walk, begun in both:
                if k and not walk.inside:
                    depth = len(walk.keys) - walk.closed
                    begun[depth] = begun.get(depth, 0) + 1
                    walk.key = None
                for _, token in walk.steps(piece):
                    if token in "{[":
                        depth = len(walk.keys) - walk.closed
                        begun[depth] = begun.get(depth, 0) + 1
        for inside, (walk, begun) in zip((False, True), both):
            rows.append({"file": file, "start": start, "inside": inside, "ends_inside": walk.inside, "closed": walk.closed, "opened": walk.keys, "begun": list(begun.items())})
    kinds = [("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("closed", pa.int32()), ("opened", pa.list_(pa.string())), ("begun", pa.map_(pa.int32(), pa.int64()))]
    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _beginnings(sums: list, depth: int) -> dict[tuple[str, int], tuple[bool, list, int, bool]]:
    """(inside a string, keys, elements begun before, whether a comma follows) of each range. sums: one row a range and beginning."""
    known = {(r["file"], r["start"], r["inside"]): r for r in sums}
    inside, keys, begun, out = False, [], 0, {}
    places = sorted({(r["file"], r["start"]) for r in sums})
    for k, (file, start) in enumerate(places):
        if k and not inside and start:  # the comma before the range; a file begins without one
            begun += len(keys) == depth
        out[file, start] = (inside, list(keys), begun, k + 1 < len(places) and places[k + 1][0] == file)
        r = known[file, start, inside]
        begun += dict(r["begun"] or {}).get(depth - len(keys), 0)
        if r["closed"] > len(keys):
            raise ValueError(f"more brackets close than open before byte {start} of {file}")
        keys = [*keys[: len(keys) - r["closed"]], *r["opened"]]
        inside = r["ends_inside"]
    if inside or keys:
        raise ValueError("the document ends inside a string or bracket")
    return out


@lru_cache(1024)
def _unquoted(key: str | None) -> str | None:
    if key == "":
        raise ValueError("a container's key holds a comma at the border of a range")
    return None if key is None else json.loads(key)


def elements(spark: SparkSession, path: str, depth: int, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(element, path, text): elements of the containers at a depth (1: those of the document itself), numbered in their order
    from 0, with the keys of the containers around them, null for arrays. An object's element is `"key": value`.
    store: writes the parts and reads them back; else the document is read once more for elements that lie in several."""
    pieces = _pieces(spark, path)
    begin = _beginnings(pieces.mapInArrow(_summed, _SUM).collect(), depth)  # two rows a range

    def read(batches):
        for file, start, found in _ranges(batches):
            inside, keys, element, comma = begin[file, start]
            walk, rows, text, at, whole = _Walk(inside, list(keys)), [], [], 0, False

            def put(ends: bool):
                nonlocal at, text
                body = "".join(text)
                if body:
                    rows.append((file, start, at, element - 1, whole and ends, [_unquoted(k) for k in around], body))
                    at += 1
                text = []

            for k, piece in enumerate(found):
                here = len(walk.keys) >= depth
                around = walk.keys[1:depth]
                if k or start:  # the comma before the piece
                    if walk.inside or len(walk.keys) != depth:
                        text.append("," if here else "")
                    elif k:
                        put(True)
                        element, whole = element + 1, True
                    else:
                        whole = True  # the range before has ended its element at this comma
                    if not walk.inside:
                        walk.key = None
                last = 0
                for place, token in walk.steps(piece):
                    now = len(walk.keys)
                    if token in "{[" and now == depth:
                        last, around = place, walk.keys[1:depth]
                        text, whole, element = [], True, element + 1
                    elif token in "}]" and now == depth - 1:
                        text.append(piece[last : place - 1])
                        put(True)
                        last, whole = place, False
                if len(walk.keys) >= depth:
                    text.append(piece[last:])
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows.clear()
            if len(walk.keys) >= depth:
                around = walk.keys[1:depth]
                # a comma between elements ends the last one; a file that the next one goes on from doesn't
                put(comma and not walk.inside and len(walk.keys) == depth)
            yield _batch(rows)

    parts = pieces.mapInArrow(read, _PART)
    parts = store(parts) if store else parts
    ordered = F.sort_array(F.collect_list(F.struct("file", "start", "at", "text")))
    cut = parts.filter("not whole").groupBy("element").agg(F.first("path").alias("path"), F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
    every = parts.filter("whole").select("element", "path", "text").unionByName(cut)
    return every.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "start": pa.int64(), "at": pa.int64(), "element": pa.int64(), "whole": pa.bool_(), "path": pa.list_(pa.string()), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds.values())], names=[*kinds])


def write_array(df: DataFrame, path: str, ord_col: str = "ord", columns: list[str] | None = None) -> None:
    """The rows as one JSON array in order, nulls among them, as parts whose bytes one after the other are the document."""
    columns = columns or [c for c in df.columns if c != ord_col]
    made = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    _write(df.select(F.lit(0).alias("group"), F.col(ord_col).alias("place"), made.alias("line")), ["["], ["]"], path)


def write_maps(df: DataFrame, path: str, names: list[str]) -> None:
    """Rows (name, key, value) as one JSON object of objects, in the order of names, as parts like those of write_array."""
    group = sum((F.when(F.col("name") == n, k).otherwise(0) for k, n in enumerate(names)), F.lit(0))
    line = F.concat(F.expr("substring(to_json(array(cast(key AS string))), 2, length(to_json(array(cast(key AS string)))) - 2)"), F.lit(": "), F.expr("substring(to_json(array(value)), 2, length(to_json(array(value))) - 2)"))
    opening = [("{" if not k else ", ") + f'"{n}": {{' for k, n in enumerate(names)]
    closing = ["}" if k < len(names) - 1 else "}}" for k in range(len(names))]
    _write(df.select(group.alias("group"), F.col("key").alias("place"), line.alias("line")), opening, closing, path)


def _write(rows: DataFrame, opening: list[str], closing: list[str], path: str) -> None:
    """rows: (group, place, line). Groups are written one after the other, lines in order of place with commas in between."""
    firsts = rows.groupBy("group").agg(F.min("place").alias("first"))
    kind = rows.schema["place"].dataType
    marks = rows.sparkSession.createDataFrame([(k, s, t) for k in range(len(opening)) for s, t in ((0, opening[k]), (2, closing[k]))], "group int, step int, line string")
    comma: Column = F.when(F.col("place") > F.col("first"), ",").otherwise("")
    lines = rows.join(F.broadcast(firsts), "group").select("group", F.lit(1).alias("step"), "place", F.concat(comma, "line").alias("line"))
    every = lines.unionByName(marks.withColumn("place", F.lit(None).cast(kind)))
    every.orderBy("group", "step", "place").select("line").write.text(path)
