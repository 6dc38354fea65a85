"""Queries of the streaming operators, over files made of driver tables."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillsieve.plans.catalogue import query, read
from quillsieve.plans.roundtrips import fresh
from quillsieve.sources import sinks
from quillsieve.streaming.resume import enrich_stream


@query("""SELECT event_id, upper(event_type) AS said, CASE WHEN event_id % 3 > 0 THEN 1 ELSE 2 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS run,
CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS attempt FROM events""")
def resumed_stream(spark, sf_dir):
    """Three starts on one checkpoint: two thirds of the events; then all of them, broken off in the middle and started
    again; then what is left to try a second time. Every id is done once, in the run that it was new or due in."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    source, target, checkpoint = (fresh(spark, name) for name in ("stream-in", "stream-out", "stream-checkpoint"))
    run = 0

    def enrich(df):
        failed = F.when((F.col("event_id") % 7 == 0) & (F.col("attempt") == 1), "busy")
        return df.withColumns({"said": F.upper("event_type"), "run": F.lit(run), "error": failed})

    def broken(df):
        raise ConnectionError("no provider")

    def start(work):
        return enrich_stream(spark, source, "event_id bigint, event_type string", target, checkpoint, work, "event_id", 3, error_col="error", attempts=2)

    for run, new in ((1, rows.filter("event_id % 3 > 0")), (2, rows)):
        sinks.append_rows(new, source)
        if run == 2:
            try:
                start(broken)
            except StreamingQueryException:
                pass  # the batch that broke off is run again by the next start
        start(enrich)
    run = 3
    return start(enrich).select("event_id", "said", "run", "attempt")
