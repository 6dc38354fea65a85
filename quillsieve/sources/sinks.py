"""Writers: JSONL with explicit nulls, CSV in input order, band subsets, append-only logs, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillsieve.operators.checks import CheckError
from quillsieve.operators.curation import free_name
from quillsieve.operators.metrics import manifest, table_digest


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def filled_answers(df: DataFrame, column: str = "answer") -> tuple[DataFrame, Observation]:
    """Rows with '0' for missing answers; the observation has `missing`, how many they were, once the rows are written."""
    seen = Observation()
    return df.observe(seen, F.count_if(F.col(column).isNull()).alias("missing")).withColumn(column, F.coalesce(column, F.lit("0"))), seen


def _in_order(ordered: DataFrame, path: str, columns: list[str], one_file: bool) -> None:
    """Sorted rows as one file, or as many as there are ranges of places, whose names sort as the places do."""
    rows = ordered.select(*columns)
    (rows.coalesce(1) if one_file else rows).write.option("header", True).csv(path)


#: Bytes of a joined file up to which the driver may copy parts where the file system can't join them itself.
COPY_BYTES = 256_000_000


def write_ordered(df: DataFrame, path: str, ord_col: str = "ord", columns: list[str] | None = None) -> None:
    """CSV in input order by many tasks: parts whose names sort as the places do, with the header once, as the first line
    of the first part. The parts' bytes one after the other are those of the file that one task would write."""
    columns = columns or [c for c in df.columns if c != ord_col]
    head, line = free_name(df.columns, "_head"), free_name(df.columns, "_line")
    lines = df.select(F.lit(1).alias(head), F.col(ord_col).alias("_ord"), F.to_csv(F.struct(*columns)).alias(line))
    title = df.sparkSession.range(1).select(F.lit(0).alias(head), F.lit(None).cast(df.schema[ord_col].dataType).alias("_ord"), F.lit(",".join(columns)).alias(line))
    lines.unionByName(title).orderBy(head, "_ord").select(line).write.text(path)


def join_parts(spark: SparkSession, folder: str, target: str) -> bool:
    """Makes one file of a folder's parts, in order of their names. Where the file system can, it links the parts' blocks and no
    byte moves; else the driver streams them, up to COPY_BYTES, and gives False. Larger ones stay as parts, with an error."""
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    where, out = fs_path(folder), fs_path(target)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f for f in fs.listStatus(where) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    if not parts:
        fs.create(out, True).close()
        return True
    if fs.getScheme() == "hdfs":  # concat takes whole files out of their folder
        fs.create(out, True).close()
        listed = spark.sparkContext._gateway.new_array(fs_path, len(parts))
        for k, part in enumerate(parts):
            listed[k] = part.getPath()
        fs.concat(out, listed)
        return True
    total = sum(f.getLen() for f in parts)
    if total > COPY_BYTES:
        raise CheckError(f"{fs.getScheme()} can't join parts, and {total} bytes are too many to copy; they stay in {folder}")
    stream = fs.create(out, True)
    for part in parts:
        source = fs.open(part.getPath())
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 16, False)
        source.close()
    stream.close()
    return False


def write_submission(df: DataFrame, path: str, ord_col: str = "ord", one_file: bool = True) -> int:
    """id,answer in input order; gives the number of missing answers. A submission is one file and so one task writes
    it; without one_file, tables of any size are written by many."""
    # observed after the sort, which looks at its input twice
    rows, seen = filled_answers(df.orderBy(ord_col))
    _in_order(rows, path, ["id", "answer"], one_file)
    return seen.get["missing"]


def write_replaced(df: DataFrame, answers: DataFrame, path: str, ord_col: str = "ord", one_file: bool = True) -> None:
    """All columns of df, with the answers of (id, answer) where there are any."""
    new = free_name(df.columns, "new")
    rows = df.join(answers.select("id", F.col("answer").alias(new)), "id", "left").withColumn("answer", F.coalesce(new, "answer"))
    _in_order(rows.orderBy(ord_col), path, [c for c in df.columns if c != ord_col], one_file)


def write_stages(rows: DataFrame, targets: dict[str, str], ord_col: str = "ord", one_file: bool = True) -> dict[str, int]:
    """Named chain stages, each to its own submission. rows: a written table, as each stage reads it."""
    return {stage: write_submission(rows.select(ord_col, "id", F.col(stage).alias("answer")), path, ord_col, one_file) for stage, path in targets.items()}


def append_rows(df: DataFrame, path: str) -> None:
    """Adds finished rows to a log that a resumed run reads."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_bands(problems: DataFrame, bands: dict[str, Column], path: str) -> None:
    """id, question and answer (empty if unknown) of each band, in folders band=<name>; a row may be in several."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bands.items()]))
    rows = problems.withColumn("band", F.explode(names)).select("id", "question", F.coalesce("answer", F.lit("")).alias("answer"), "band")
    rows.write.partitionBy("band").option("header", True).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the emitted files of a folder, from their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: Hashes that are joined into one at each level of a tree digest.
FAN = 4096


def tree_digests(lines: DataFrame, store, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(file, lines, bytes, digest) of numbered lines (file, line, value) of files of any size: the SHA-256 of each line, then
    of up to `fan` hashes in order, written one after the other, until one is left. No row holds more than `fan` hashes,
    and the digest doesn't depend on how the file was split. Bytes are those of the lines with a line end each.
    levels: a tree of fixed height; after so many times the hashes that are left, one for fan ** levels lines, become one."""
    level = lines.select("file", (F.col("line") - 1).alias("k"), F.sha2("value", 256).alias("h"), F.lit(1).cast("long").alias("lines"), (F.octet_length("value") + 1).cast("long").alias("bytes"))
    done, at = F.lit(False), 0
    while True:
        group = F.lit(0).cast("long") if at == levels else F.floor(F.col("k") / fan)
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        # a file that has its one hash waits for the others
        level = store(level.groupBy("file", group.alias("k")).agg(F.when(done, F.max("h")).otherwise(F.sha2(joined, 256)).alias("h"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")))
        if level.filter("k > 0").isEmpty():
            return level.select("file", "lines", "bytes", F.col("h").alias("digest"))
        done, at = (F.count(F.lit(1)) == 1) & (F.min("k") == 0), at + 1


def write_manifest(df: DataFrame, path: str, written_to: str | None = None, **sections) -> None:
    """Counts and digest of a written table as pretty JSON text beside it, and digests of the files themselves."""
    digest = table_digest(df).first()  # one row
    files = {r["name"]: r["sha256"] for r in file_digests(df.sparkSession, written_to).collect()} if written_to else {}  # one a file
    text = manifest(rows=digest["rows"], digest=digest["digest"], columns=df.columns, files=files, **sections)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
