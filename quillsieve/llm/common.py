"""What the operators share: the shared scratch folder, written intermediate tables, tables by name."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from contextlib import contextmanager, suppress
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class of the six ASCII white-space characters that separate words, for Java and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a new temporary folder, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillsieve-")
    return _own[app]


#: Paths given out so far, with the session; what is left of them goes when the driver ends.
_made: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch():
    """Tables that are written inside go at the end: for work whose result is written as well."""
    before = len(_made)
    yield
    for spark, path in _made[before:]:
        delete(spark, path)
    del _made[before:]


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        with suppress(Exception):  # the session may be gone
            delete(spark, path)


#: Rows a file of a table whose number of rows is bounded.
ROWS_A_FILE = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and a lost
    executor costs no more than a read. rows: an upper bound of its rows, so that a small table has few files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Removes the files of a written table that nothing reads any more. Whatever was made of it must have been
    written itself."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(columns, name: str) -> str:
    """A column name that no column has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def count_words(text):
    """Column: number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


class BitMap:
    """Which 64-bit keys may be among a set: a fixed number of bits."""

    def __init__(self, keys: DataFrame, column: str, bits: int):
        place = F.pmod(F.col(column), F.lit(bits))
        words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("set"))
        self.data, found = np.zeros(bits // 64, np.int64), words.toArrow()  # at most bits / 64 rows
        self.data[found.column("word").to_numpy()] = found.column("set").to_numpy()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set."""
        at = np.mod(keys, len(self.data) * 64).astype(np.uint64)
        return (self.data.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose key may be in the set, for tables of numbers."""
        k = df.columns.index(column)

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(self(batch.column(k).to_numpy())))

        return df.mapInArrow(run, df.schema)

    def column(self, name: str):
        """Column: whether the key may be in the set; only the keys go to Python."""

        @F.arrow_udf("boolean")
        def maybe(keys: pa.Array) -> pa.Array:
            return pa.array(self(keys.to_numpy()))

        return maybe(F.col(name))


@cache
def _libc():
    return ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


def trim() -> None:
    """Gives memory that is free but kept back to the system: workers stay between tasks, with all that their largest task took."""
    pa.default_memory_pool().release_unused()
    if _libc() and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def small_batches(batches, rows: int = 500, lean: bool = False):
    """Record batches of few rows, so that texts become Python objects a few at a time; unused Arrow memory
    goes back in between, since idle workers keep their processes. lean: all that is unused goes back, from before the first
    batch on."""
    if lean:
        trim()
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        trim() if lean else pa.default_memory_pool().release_unused()
