"""Stops: gap-tolerant sessions of slow points, their extent, and which are kept.

All windows share ``partitionBy(mmsi)``, so a track is shuffled once.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_km, per_second, seconds_between

TRACK = ("ts", "row_ord")


def _forward(by: tuple[str, ...] = ("mmsi",)):
    return Window.partitionBy(*by).orderBy(*TRACK)


def last_known(c: Column, backward: bool = False) -> Column:
    """The nearest non-null value up to this row, or with ``backward`` from it on."""
    order = [F.col(x).desc() for x in TRACK] if backward else list(TRACK)
    return F.last(c, ignorenulls=True).over(Window.partitionBy("mmsi").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def ordered(points: DataFrame) -> DataFrame:
    """Adds ``idx``, the position in the vessel's track."""
    return points.withColumn("idx", (F.row_number().over(_forward()) - 1).cast("long"))


def deltas(points: DataFrame) -> DataFrame:
    """Absolute changes of lat and lon_360 and seconds since the previous row, raw and per second."""
    w = _forward()
    df = points.withColumn("time_diff", seconds_between("ts", F.lag("ts").over(w)))
    for c, out in (("lat", "lat_diff"), ("lon_360", "lon_diff")):
        df = df.withColumn(out, F.abs(F.col(c) - F.lag(c).over(w)))
        df = df.withColumn(f"{out}_rate", per_second(out, "time_diff"))
    return df


def slow_only(points: DataFrame, sog: float = 0.5) -> DataFrame:
    """Stop points by speed alone."""
    return points.withColumn("is_stop", F.coalesce(F.col("sog") < sog, F.lit(False)))


def slow_and_still(points: DataFrame, sog: float = 0.5, still: float = 1e-4) -> DataFrame:
    """Stop points by speed and by change of position; the first row of a track is none."""
    df = deltas(points)
    rule = (F.col("sog") < sog) & (F.col("lat_diff_rate") < still) & (F.col("lon_diff_rate") < still)
    return df.withColumn("is_stop", F.coalesce(rule, F.lit(False)))


def sessions(points: DataFrame, gap_s: float = 120.0) -> DataFrame:
    """Adds ``stop_id``, from 1, on every row of a stop, including rows in motion inside it.

    A stop ends at a row in motion more than ``gap_s`` after the last stop point; a gap without rows never
    ends one.  So a stop point opens a stop if there was none, or if the row before it is such a row.
    """
    w = _forward()
    stop_ts = F.when(F.col("is_stop"), F.col("ts"))
    df = points.withColumn("_last", F.last(stop_ts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    broken = ~F.lag("is_stop").over(w) & (seconds_between(F.lag("ts").over(w), "_last") > gap_s)
    df = df.withColumn("_new", F.col("is_stop") & (F.col("_last").isNull() | F.coalesce(broken, F.lit(False))))
    seg = F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_seg", F.when(F.col("is_stop"), seg))
    df = df.withColumn("_bwd", last_known(F.col("_seg"))).withColumn("_fwd", last_known(F.col("_seg"), backward=True))
    return df.withColumn("stop_id", F.when(F.col("_bwd") == F.col("_fwd"), F.col("_bwd"))).drop("_last", "_new", "_seg", "_bwd", "_fwd")


def segments(marked: DataFrame, min_duration_s: float = 1800.0, max_r95_km: float | None = 0.3) -> DataFrame:
    """One row per stop: extent, median centre, mean position, 95 % radius, and whether it is kept."""
    inside = marked.where("stop_id is not null")
    size = inside.groupBy("mmsi", "stop_id").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.count("*").alias("n_points"), F.median("lat").alias("center_lat"), F.median("lon").alias("center_lon"),
        F.avg("lat").alias("mean_lat"), F.avg("lon_360").alias("mean_lon_360"),
    )
    away = haversine_km("lat", "lon", "center_lat", "center_lon")
    radius = inside.join(size.select("mmsi", "stop_id", "center_lat", "center_lon"), ["mmsi", "stop_id"]).groupBy("mmsi", "stop_id").agg(F.percentile(away, F.lit(0.95)).alias("r95_km"))
    out = size.join(radius, ["mmsi", "stop_id"]).withColumn("duration_s", seconds_between("end_ts", "start_ts"))
    kept = F.col("duration_s") >= min_duration_s
    if max_r95_km is not None:
        kept = kept & (F.col("r95_km") <= max_r95_km)
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))
