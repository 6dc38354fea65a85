"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

write_archives() makes one record per page, an HTTP response in chunked transfer framing. A block longer
than `segment_bytes` is cut into a first record (WARC-Segment-Number 1) and continuation records that name
it by WARC-Segment-Origin-ID; the last one has WARC-Segment-Total-Length. Of pages with equal payloads of
at least `revisit_bytes`, those with the largest id are responses and the others are revisits of it.
A revisit names its response by target URI and date, and by page id. Each task begins with a warcinfo record.
Records are written by Spark's text writer, whose line separator is the two line ends that close a record,
so the files are plain WARC in any store that Spark can write.

read_archives() reads whole files (kept small by `records_per_file`), cuts them by Content-Length, groups
segments by origin identifier, orders them by number, verifies numbers and total length and decodes the
chunked framing. Records that aren't segmented are decoded where they are read; only segments travel.

Defined results: null html is an empty payload; a null url leaves out the target; a null id is smaller than
any other and is kept as null; repeated rows are records of their own, and all rows with the largest id of
a group are responses; an empty table gives an empty archive and an empty result; other columns are ignored.
A segment that is missing, doubled or of the wrong length, and a broken chunk, raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm.common import fresh_path, written

END = b"\r\n"
VERSION = b"WARC/1.1"
PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.binary()), ("block", pa.binary())])


def chunked(payload: bytes, size: int = 4096) -> bytes:
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%x" % len(part), END, part, END]
    return b"".join([*out, b"0", END, END])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(END, at)
        if line < 0:
            raise ValueError("chunked body ends early")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("chunk of a wrong length")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Without the two line ends that close a record: the writer adds them."""
    head = [VERSION.decode(), f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + END + block


DATE = "2024-01-01T00:00:00Z"


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=")


def info_record() -> bytes:
    head = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
    return record("warcinfo", head, b"software: quillsieve" + END + b"format: WARC File Format 1.1" + END)


def page_records(page_id, url, html: str | None, digest: str, refers_to, refers_url, segment_bytes: int) -> list[bytes]:
    payload = (html or "").encode()
    name = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [
        ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record("revisit", [*fields, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", refers_to)], http)]
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        return [record("response", fields, block)]
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = [record("response", [*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n)]
        out.append(record("continuation", [*more, ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 8192, revisit_bytes: int = 1000, records_per_file: int = 1000, id_col: str = "page_id") -> None:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    last = F.max(F.struct("page_id", "url"))  # of rows equal in id, the largest url
    groups = slim.filter(F.col("n") >= revisit_bytes).groupBy("digest").agg(last["page_id"].alias("top"), last["url"].alias("top_url"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("least"))
    # ids that revisit: of groups with more than one id only, so that rows of one kind need no join partner
    again = groups.filter("top > least").select("digest", "top", "top_url")
    visits = slim.filter(F.col("n") >= revisit_bytes).join(again, "digest").filter("page_id is null or page_id < top").select("page_id", "digest", "top", "top_url").distinct()
    visits = written(visits, "revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "top", "top_url")
    plan = rows.join(visits, (F.col("page_id").eqNullSafe(F.col("_id"))) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "top", "top_url")

    def run(batches):
        for number, batch in enumerate(batches):
            if not number:
                yield pa.RecordBatch.from_arrays([pa.array([info_record()], pa.binary())], names=["value"])
            found = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in page_records(*row, segment_bytes)]
            for k in range(0, len(found), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 2000], pa.binary())], names=["value"])

    records = plan.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes):
    """Yields (fields, block) of each record."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        stop = data.find(END + END, at)
        fields = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        if data[end : end + 4] != END + END:
            raise ValueError(f"record of a wrong length at byte {at}")
        yield fields, data[begin:end]
        at = end + 4


def page_of(fields: dict, block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    url = unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    if fields["WARC-Type"] == "revisit":
        return number("X-Page-ID"), url, None, number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", number("X-Refers-To-Page-ID")
    head, _, body = block.partition(END + END)
    payload = unchunked(body) if re.search(rb"(?mi)^transfer-encoding:\s*chunked", head) else body
    digest = hashlib.sha1(payload).hexdigest()
    if "WARC-Payload-Digest" in fields and fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"payload of {fields['WARC-Record-ID']} has another digest")
    return number("X-Page-ID"), url, payload, len(payload), digest, "response", None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _whole(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            rows = []
            for fields, block in parse(batch.column(0)[k].as_py()):
                if "WARC-Segment-Number" not in fields and fields["WARC-Type"] in ("response", "revisit"):
                    rows.append(page_of(fields, block))
            yield _batch(rows, _PAGE)


def _segments(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            rows = []
            for fields, block in parse(batch.column(0)[k].as_py()):
                if "WARC-Segment-Number" in fields:
                    head = "\n".join(f"{a}: {b}" for a, b in fields.items()).encode() if fields["WARC-Type"] == "response" else None
                    total = fields.get("WARC-Segment-Total-Length")
                    rows.append((fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), int(fields["WARC-Segment-Number"]), None if total is None else int(total), head, block))
            yield _batch(rows, _SEGMENT)


def _assemble(group: list[tuple]) -> tuple:
    """One record's page from its segments (number, total, head, block), in order of number."""
    numbers, totals = [r[0] for r in group], [r[1] for r in group if r[1] is not None]
    block = b"".join(r[3] for r in group)
    if numbers != list(range(1, len(numbers) + 1)) or group[0][2] is None or totals != [len(block)]:
        raise ValueError(f"segments {numbers} with {len(block)} bytes do not make a record of {totals} bytes")
    return page_of(dict(line.split(": ", 1) for line in group[0][2].decode().split("\n")), block)


def _reassemble(batches):
    """Rows come sorted by origin and number, the segments of an origin in one partition."""
    origin, group = None, []
    for batch in batches:
        rows = []
        for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if name != origin and group:
                rows.append(_assemble(group))
                group = []
            origin = name
            group.append(row)
        yield _batch(rows, _PAGE)
    if group:
        yield _batch([_assemble(group)], _PAGE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    whole = files.mapInArrow(_whole, PAGE)
    segments = files.mapInArrow(_segments, "origin string, number int, total long, head binary, block binary")
    joined = segments.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_reassemble, PAGE)
    return whole.unionByName(joined)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)


def digests(read: DataFrame) -> DataFrame:
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
