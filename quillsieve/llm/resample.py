"""Resampling of irregular series to the clock hours of a zone, without windows.

A point (key, second, value) holds until the next point of its key, at most `cap` seconds. Points go into bins as wide
as the cap, so a successor within reach lies in the same bin or in the following one: the bin table meets itself by an
equi-join on (key, bin), where each bin learns the first point of the following bin. Within a bin the least later second
is the neighbour in the bin's points in order of time: seconds of a key are unique, so a bin has `cap` points at most,
and a pairwise join inside bins would make the square of that. Whoever has no successor there is capped. The pieces
between a point and its end are then cut at bucket borders and summed.

A key of a third of all rows is spread over its bins; repeated points of one second are reduced before they move.
Everything is exact integer arithmetic: with w - v = q * d + r, floor((w - v) * u * u / d) is q * u * u +
floor(r * u * u / d), where r and u stay below the cap.

Defined results: rows with a null key, time or value don't count, nor do values that aren't finite or whose integral over
the cap or a bucket wouldn't fit 64 bits (`most_cents`). Of a key's rows in one second the one with the largest order
column stays, null being the least, and of rows equal in that the largest value. Times without a zone are UTC. Times
before 1970 are floored, too. Other columns, whatever their names, don't matter. An empty table gives an empty result.
Buckets start where the clock of the zone shows a multiple of `width`, with the zone's offset at the point; a change of
the offset by other than whole buckets within one piece would be missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import written

CAP = 3600
WIDTH = 3600


def most_cents(cap: int = CAP, width: int = WIDTH) -> int:
    """Largest value of which twice the integral over the cap or a bucket fits 64 bits."""
    return (2**63 - 1) // (2 * max(cap, width) + 2)


def _floor_div(a: Column, b: Column) -> Column:
    """Exact floor of a quotient of longs, for positive b."""
    return F.call_function("div", a - F.pmod(a, b), b)


def second_of(df: DataFrame, column: str) -> Column:
    """Epoch second, floored; times without a zone are UTC."""
    kind = dict(df.dtypes)[column]
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)") if kind == "timestamp_ntz" else F.unix_micros(column)
    return _floor_div(micros, F.lit(1_000_000))


def points(df: DataFrame, key: str = "client_id", time: str = "ts", value: str = "value", order: str = "click_id", limit: int | None = None) -> DataFrame:
    """(key, sec, v): one point a key and second, v in cents."""
    limit = most_cents() if limit is None else limit
    cents = F.floor(F.col(value) * 100 + 0.5)
    rows = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull())
    # NaN is larger than all numbers here, so it goes, too
    rows = rows.filter(F.abs(F.col(value).cast("double")) * 100 <= F.lit(float(limit - 1)))
    rows = rows.select(F.col(key).alias("key"), second_of(df, time).alias("sec"), F.col(order).alias("rank"), cents.cast("long").alias("v"))
    return rows.groupBy("key", "sec").agg(F.max(F.struct("rank", "v")).alias("last")).select("key", "sec", F.col("last.v").alias("v"))


def successors(pts: DataFrame, cap: int = CAP) -> DataFrame:
    """(key, sec, v, next_sec, next_v): the next point at most cap seconds later, null if there is none."""
    binned = pts.withColumn("bin", _floor_div(F.col("sec"), F.lit(cap)))
    # at most cap points a bin, since seconds are unique
    bins = binned.groupBy("key", "bin").agg(F.sort_array(F.collect_list(F.struct("sec", "v"))).alias("p"))
    firsts = binned.groupBy("key", (F.col("bin") - 1).alias("bin")).agg(F.min("sec").alias("sec"), F.min_by("v", "sec").alias("v"))
    firsts = firsts.select("key", "bin", F.struct("sec", "v").alias("following"))
    met = bins.join(firsts.hint("merge"), ["key", "bin"], "left")  # grows with the input, so never broadcast
    later = F.concat(F.slice("p", F.lit(2), F.size("p")), F.array("following"))
    met = met.select("key", F.inline(F.arrays_zip(F.col("p").alias("p"), later.alias("q"))))
    reached = F.col("q.sec") - F.col("p.sec") <= cap
    return met.select("key", "p.*", F.when(reached, F.col("q.sec")).alias("next_sec"), F.when(reached, F.col("q.v")).alias("next_v"))


def _offset(second: Column, zone: str) -> Column:
    """Seconds that the zone's clock is ahead of UTC."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(second), zone)) - second


def resample(pts: DataFrame, signal: str = "linear", zone: str = "UTC", width: int = WIDTH, cap: int = CAP) -> DataFrame:
    """(key, bucket_start, n_points, covered_seconds, area2, avg_cents) of the buckets that hold points or covered time.
    signal: `step` holds a value until the next point or the cap; `linear` runs straight to the next point, and covers
    nothing if none is within the cap."""
    if signal not in ("step", "linear"):
        raise ValueError("signal is step or linear")
    seg = successors(pts, cap)
    shift = F.pmod(F.col("sec") + _offset(F.col("sec"), zone), F.lit(width))
    end = F.coalesce("next_sec", F.col("sec") + cap if signal == "step" else F.col("sec"))
    rise = F.coalesce(F.col("next_v") - F.col("v"), F.lit(0)) if signal == "linear" else F.lit(0).cast("long")
    seg = seg.select("key", "sec", "v", (end - F.col("sec")).alias("d"), rise.alias("rise"), shift.cast("long").alias("shift"))
    # the piece of bucket k runs from k * width - shift to the next border, in seconds from the point
    k = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), _floor_div(F.col("shift") + F.col("d") - 1, F.lit(width))))
    cut = seg.select("*", F.explode(k).alias("k"))
    u1 = F.greatest(F.lit(0), F.col("k") * width - F.col("shift"))
    u2 = F.greatest(u1, F.least(F.col("d"), (F.col("k") + 1) * width - F.col("shift")))
    cut = cut.select("key", "v", "d", "rise", (F.col("sec") - F.col("shift") + F.col("k") * width).alias("bucket_start"), (F.col("k") == 0).cast("long").alias("n"), u1.alias("u1"), u2.alias("u2"))
    d = F.greatest(F.col("d"), F.lit(1))
    q, r = _floor_div(F.col("rise"), d), F.pmod("rise", d)

    def area(u: Column) -> Column:
        return 2 * F.col("v") * u + q * u * u + _floor_div(r * u * u, d)

    made = area(F.col("u2")) - area(F.col("u1")) if signal == "linear" else 2 * F.col("v") * (F.col("u2") - F.col("u1"))
    sums = cut.groupBy("key", "bucket_start").agg(F.sum("n").alias("n_points"), F.sum(F.col("u2") - F.col("u1")).alias("covered_seconds"), F.sum(made).alias("area2"))
    covered = F.col("covered_seconds")
    return sums.withColumn("avg_cents", F.when(covered > 0, _floor_div(F.col("area2"), 2 * covered)))


def digests(clicks: DataFrame, zone: str, signal: str = "linear") -> DataFrame:
    """Buckets of all clients, hours of the zone's clock."""
    pts = written(points(clicks), "points")
    return resample(pts, signal, zone).withColumnRenamed("key", "client_id")
