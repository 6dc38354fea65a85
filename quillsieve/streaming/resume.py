"""Resumable enrichment as a stream with state.

The state store holds the ids that are done, on RocksDB, so a batch costs its own rows and never a read of what was
written before. The checkpoint remembers files, state and batch together; a batch is written into a folder of its number,
so a replayed batch replaces itself, and a restart neither repeats nor loses rows. Ids are kept for good, or for `keep`
after the newest time seen where rows carry a time.

A row that comes back with an error is filed into `retries` with one attempt more. An attempt of an id is a key
of its own, so the next start takes it up, until `attempts` are spent; the last one is written with its error.

Defined results: null ids are one id, and rows of an id are one row, whichever comes first; rows equal to others in a
batch are done once; with `keep`, a row whose time lies further back than that counts as late: the run ends with an
error that gives their number instead of losing them in silence; an empty source gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.operators.checks import CheckError
from quillsieve.sources.readers import exists

ATTEMPT = "attempt"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession):
    """State on RocksDB while a query starts; the session's own choice comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def fresh_rows(stream: DataFrame, id_col: str, time_col: str | None = None, keep: str | None = None) -> DataFrame:
    """Rows of attempts whose id isn't in the state yet; without `keep` the state forgets nothing."""
    keys = [id_col, ATTEMPT]
    if keep is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(keys)


def enrich_stream(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame],
    id_col: str = "id", files_per_batch: int = 16, time_col: str | None = None, keep: str | None = None, error_col: str | None = None, attempts: int = 1,
) -> DataFrame:
    """Runs `enrich` on rows of new JSON files whose id isn't done yet, ends when no file is left, and gives all that is
    written so far with the attempt of each row. error_col: a column of enriched rows, null where they succeeded."""
    fields = T.StructType.fromDDL(schema)
    wide = T.StructType([*[f for f in fields if f.name != ATTEMPT], T.StructField(ATTEMPT, T.IntegerType())])
    retries = f"{checkpoint.rstrip('/')}-retries"
    _make_folder(spark, retries)

    def batch(rows: DataFrame, number: int) -> None:
        done = enrich(rows)
        if error_col is None or attempts == 1:
            done.write.mode("overwrite").parquet(f"{target}/batch={number}")
            return
        again = F.col(error_col).isNotNull() & (F.col(ATTEMPT) < attempts)
        # enriched once: what comes back isn't deterministic
        done.write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}-enriched/batch={number}")
        done = spark.read.schema(done.schema).parquet(f"{checkpoint.rstrip('/')}-enriched/batch={number}")
        filed = done.filter(again).withColumn(ATTEMPT, F.col(ATTEMPT) + 1).select(*wide.names)
        filed.write.mode("overwrite").option("ignoreNullFields", False).json(f"{retries}/batch={number}")
        done.filter(~again).write.mode("overwrite").parquet(f"{target}/batch={number}")

    def files(path: str, **options) -> DataFrame:
        rows = spark.readStream.schema(wide).option("maxFilesPerTrigger", files_per_batch).options(**options).json(path)
        return rows.withColumn(ATTEMPT, F.coalesce(ATTEMPT, F.lit(1)))

    # rows of the source are first attempts; those filed are read by their batch folders
    stream = files(source)
    if error_col is not None and attempts > 1:
        stream = stream.unionByName(files(retries, recursiveFileLookup=True))
    with _rocks(spark):
        query = fresh_rows(stream, id_col, time_col, keep).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    if late:
        raise CheckError(f"{late} rows are later than {keep}")
    if not exists(spark, target):
        return enrich(spark.createDataFrame([], wide))
    return spark.read.option("basePath", target).parquet(target).drop("batch")


def _make_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
