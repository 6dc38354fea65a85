"""Readers of CSV, JSONL and JSON files with explicit schemas, through Spark's own sources only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillsieve.functions.text import canonical, strict_integer
from quillsieve.operators.checks import CheckError, duplicate_ids, require_columns, require_empty
from quillsieve.sources import jsondoc

CORRUPT = "_corrupt"
#: Byte ranges of files up to which their line counts are broadcast.
SMALL_RANGES = 100_000
#: Writes a frame that is read more than once, and reads it back.
Store = Callable[[DataFrame], DataFrame]


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-string rows; a byte-order mark is dropped, quoted fields may hold line ends, an empty field is null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, keys that a row lacks are null."""
    return spark.read.schema(schema).json(path)


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSONL by suffix, else CSV."""
    if path.rstrip("/").endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema)
    return read_csv(spark, path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON array of any size, with `ord`."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = jsondoc.elements(spark, path, 1).select(F.col("element").alias("ord"), F.from_json("text", fields).alias("row"))
    return rows.select("ord", "row.*")


def numbered_lines(spark: SparkSession, path: str | list[str], store: Store) -> DataFrame:
    """(file, line, place, value) of text files, lines from 1, blank ones too; place counts on over all files in order of their
    names. A file is read in byte ranges by many tasks; a line's number is its place in its range and the number of lines
    in the ranges before. store: writes a frame and reads it back, since places must not be counted twice."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    rows = store(rows)
    ranges = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row a range
    before, all_before = (F.sum("n").over(w) - F.col("n") - F.col("first") for w in (Window.partitionBy("file").orderBy("start"), Window.orderBy("file", "start")))
    ranges = store(ranges.select(F.col("file").alias("f"), F.col("start").alias("s"), before.alias("shift"), all_before.alias("far")))
    small = F.broadcast(ranges) if ranges.count() <= SMALL_RANGES else ranges
    met = rows.join(small, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    return met.select("file", (F.col("at") + F.col("shift") + 1).alias("line"), (F.col("at") + F.col("far") + 1).alias("place"), "value")


def checked_predictions(spark: SparkSession, path: str, schema: str | T.StructType, store: Store, id_col: str = "id", integers: tuple[str, ...] = ("prediction",), ord_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSONL files with canonical integers, and (file, line, problem, found): lines that aren't JSON objects, lines
    without an id, all but the first line of an id, and answers that aren't integers. Blank lines count as lines only. The
    files are read and parsed once."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    lines = numbered_lines(spark, path, store).filter(F.regexp_replace("value", r"\s+", "") != "")
    rows = lines.select("file", "line", "place", F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"), F.substring("value", 1, 80).alias("text"))
    rows = store(rows)
    broken, key = F.col(f"r.{CORRUPT}").isNotNull() | F.col("r").isNull(), F.col(f"r.{id_col}")
    problems = [F.when(broken, F.struct(F.lit("not a JSON object").alias("problem"), F.col("text").alias("found"))), F.when(~broken & key.isNull(), F.struct(F.lit("no id").alias("problem"), F.col("text").alias("found")))]
    for column in integers:
        told = F.col(f"r.{column}")
        problems.append(F.when(~broken & told.isNotNull() & strict_integer(told).isNull(), F.struct(F.lit(f"{column} isn't an integer").alias("problem"), told.cast("string").alias("found"))))
    bad = rows.select("file", "line", F.explode(F.array_compact(F.array(*problems))).alias("p")).select("file", "line", "p.*")
    good = rows.filter(~broken & key.isNotNull())
    places = good.groupBy(key.alias("key")).agg(F.min(F.struct("file", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = good.select("file", "line", key.alias("key")).join(places, "key").filter(F.struct("file", "line") != F.col("first"))
    bad = bad.unionByName(again.select("file", "line", F.lit("duplicate id").alias("problem"), F.col("key").cast("string").alias("found")))
    out = good.select(*[F.col(f"r.{f.name}").alias(f.name) for f in fields], *([F.col("place").alias(ord_col)] if ord_col else []))
    return out.withColumns({column: strict_integer(F.col(column)) for column in integers}), bad


def read_predictions(spark: SparkSession, path: str, schema: str | T.StructType, store: Store, id_col: str = "id", integers: tuple[str, ...] = ("prediction",), ord_col: str | None = None) -> DataFrame:
    """JSONL that must parse, have unique ids and integer answers; an error names the first problems with file and line.
    ord_col: a column for the rows' places in the input."""
    rows, bad = checked_predictions(spark, path, schema, store, id_col, integers, ord_col)
    require_empty(bad.orderBy("file", "line"), "lines that can't be used")
    return rows


def read_submission(spark: SparkSession, path: str, store: Store | None = None) -> DataFrame:
    """(id, answer) with unique ids and integer answers. store: writes the rows and reads them back; else the files are read
    for each check."""
    rows = read_csv(spark, path)
    require_columns(rows, "id", "answer")
    rows = store(rows.select("id", "answer")) if store else rows
    require_empty(duplicate_ids(rows), "duplicate ids")
    require_empty(rows.filter(strict_integer(F.col("answer")).isNull()), "answers that aren't integers")
    return rows.select("id", strict_integer(F.col("answer")).alias("answer"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer): `id` and the canonical integer of the answer column, or of the second column where there is none."""
    rows = read_csv(spark, path)
    require_columns(rows, "id")
    column = "answer" if "answer" in rows.columns else rows.columns[1]
    return rows.select("id", canonical(F.col(column)).alias("answer"))


def read_pinned(spark: SparkSession, path: str, revision: str, split: str | None = None, kind: str = "parquet", schema: str | T.StructType | None = None) -> DataFrame:
    """A corpus under a folder of its revision, and of its split if it has one, as Parquet, JSON lines or CSV."""
    folder = "/".join([path.rstrip("/"), revision, *([split] if split else [])])
    if not exists(spark, folder):
        raise CheckError(f"no revision {revision} of {path}" + (f" with a split {split}" if split else ""))
    if kind == "parquet":
        return spark.read.parquet(folder)
    return read_jsonl(spark, folder, schema) if kind == "jsonl" else read_csv(spark, folder)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_pools(spark: SparkSession, paths: list[str], schema: str | T.StructType, optional: bool = True) -> DataFrame:
    """Files of one logical table, with `pool` as the file's name; missing ones are skipped if optional."""
    found = [p for p in paths if exists(spark, p)]
    if not optional and len(found) < len(paths):
        raise CheckError(f"missing files: {sorted(set(paths) - set(found))}")
    if not found:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("pool", T.StringType())]))
    return read_jsonl(spark, found, schema).withColumn("pool", F.col("_metadata.file_name"))
