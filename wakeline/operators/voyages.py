"""Voyages: what lies between consecutive kept stops, its labels, measures and quality."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import EARTH_KM, haversine_km, heading_change, lon_from_360, near_port_flag, seconds_between
from wakeline.operators.stops import last_known

KEY = ("mmsi", "voyage_id")


def label(marked: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds ``voyage_id`` (per vessel, from 1) and ``real_eta_sec``, seconds to the next kept stop's first row.

    A row is in a voyage if it is in no kept stop and has kept stops on either side.
    """
    kept = segments.where("kept").withColumn("_rank", F.row_number().over(Window.partitionBy("mmsi").orderBy("stop_id")).cast("long"))
    df = marked.join(kept.select("mmsi", "stop_id", "_rank", F.col("start_ts").alias("_start")), ["mmsi", "stop_id"], "left")
    df = df.withColumn("_prev", last_known(F.col("_rank"))).withColumn("_next", last_known(F.col("_start"), backward=True))
    inside = F.col("_rank").isNull() & F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    df = df.withColumn("voyage_id", F.when(inside, F.col("_prev"))).withColumn("real_eta_sec", F.when(inside, seconds_between("_next", "ts")))
    return df.withColumn("kept_stop", F.col("_rank").isNotNull()).drop("_rank", "_start", "_prev", "_next")


def _steps(labelled: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("idx")
    df = labelled.where("voyage_id is not null")
    km = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return df.withColumn("step_km", km).withColumn("step_s", seconds_between("ts", F.lag("ts").over(w)))


def heading_cum(labelled: DataFrame) -> DataFrame:
    """Sum of the turns of a voyage; 511 and missing headings are dropped before turns are taken."""
    known = labelled.where("voyage_id is not null and heading is not null and heading <> 511")
    turn = heading_change("heading", F.lag("heading").over(Window.partitionBy(*KEY).orderBy("idx")))
    return known.withColumn("_turn", turn).groupBy(*KEY).agg(F.coalesce(F.sum("_turn"), F.lit(0.0)).alias("heading_cum_deg"))


def summarise(labelled: DataFrame) -> DataFrame:
    """One row per voyage: extent, ends, measures."""
    ends = {"start_idx": ("idx", F.min_by), "end_idx": ("idx", F.max_by), "dep_time": ("ts", F.min_by), "arr_time": ("ts", F.max_by),
            "dep_lat": ("lat", F.min_by), "dep_lon": ("lon", F.min_by), "arr_lat": ("lat", F.max_by), "arr_lon": ("lon", F.max_by)}
    df = _steps(labelled).groupBy(*KEY).agg(
        *(by(c, "idx").alias(name) for name, (c, by) in ends.items()),
        F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("path_len_km"), F.count("*").alias("n_points"), F.max("step_s").alias("max_gap_s"),
    )
    df = df.withColumn("duration_hr", seconds_between("arr_time", "dep_time") / 3600)
    df = df.withColumn("displacement_km", haversine_km("dep_lat", "dep_lon", "arr_lat", "arr_lon"))
    if "heading" not in labelled.columns:
        return df.withColumn("heading_cum_deg", F.lit(0.0))
    return df.join(heading_cum(labelled), list(KEY), "left").fillna({"heading_cum_deg": 0.0})


def large_gap(labelled: DataFrame, hours: float = 2.0) -> DataFrame:
    return _steps(labelled).groupBy(*KEY).agg(F.coalesce(F.max("step_s") > hours * 3600, F.lit(False)).alias("large_gap"))


def nearest(points: DataFrame, places: DataFrame, key: list[str], lat: str, lon: str, name: str, order: str, within: list[str] = (), out: str = "nearest") -> DataFrame:
    """The nearest place for each key and its distance; of equals, the first by ``order``.

    Places are few (ports, stop centres); each point keeps one candidate in the aggregate, so pairs are
    never stored.  ``within`` limits pairs to equal columns, such as the vessel.
    """
    p = places.select(*within, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(name).alias("_name"), F.col(order).alias("_order"))
    pairs = points.join(p, list(within), "left") if within else points.join(p, F.lit(True), "left")
    d = haversine_km(lat, lon, "_lat", "_lon")
    best = F.min(F.when(d.isNotNull(), F.struct(d.alias("d"), F.col("_order").alias("o"), F.col("_name").alias("n")))).alias("_best")
    return pairs.groupBy(*key).agg(best).select(*key, F.col("_best.n").alias(out), F.col("_best.d").alias(f"{out}_km"))


def _cubes(lat: str, lon: str, side: float) -> list[Column]:
    """The cube of side ``side`` that holds a position's unit vector."""
    a, o = F.radians(lat), F.radians(lon)
    return [F.floor(x / side).cast("long") for x in (F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))]


def nearest_within(points: DataFrame, places: DataFrame, key: list[str], lat: str, lon: str, name: str, order: str, km: float, out: str = "nearest", within: list[str] = ()) -> DataFrame:
    """``nearest`` among the places at most ``km`` away; keys without any are left out.

    A place enters the 27 cubes around it, whose side is the chord of ``km``, and an equi-join finds the
    places in a point's cube: work follows the places nearby, wherever on the globe, not all of them.
    """
    side = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    cube = ["_cx", "_cy", "_cz"]
    p = places.select(*within, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(name).alias("_name"), F.col(order).alias("_order"))
    for c, at in zip(cube, _cubes("_lat", "_lon", side), strict=True):
        p = p.withColumn(c, F.explode(F.sequence(at - 1, at + 1)))
    own = points.select(*key, F.col(lat).alias("_plat"), F.col(lon).alias("_plon"))
    pairs = own.withColumns(dict(zip(cube, _cubes("_plat", "_plon", side), strict=True))).join(p, [*within, *cube])
    pairs = pairs.withColumn("_d", haversine_km("_plat", "_plon", "_lat", "_lon")).where(F.col("_d") <= km)
    best = F.min(F.struct(F.col("_d").alias("d"), F.col("_order").alias("o"), F.col("_name").alias("n"))).alias("_best")
    return pairs.groupBy(*key).agg(best).select(*key, F.col("_best.n").alias(out), F.col("_best.d").alias(f"{out}_km"))


def nearest_of_vessel(ends: DataFrame, centers: DataFrame, key: list[str], lat: str, lon: str, out: str, reaches: tuple[float, ...] = (5.0, 100.0)) -> DataFrame:
    """The nearest stop centre of the vessel, in growing reaches: only ends without a centre within one go on to the next, and at last to all."""
    found, left = None, ends
    for km in reaches:
        got = nearest_within(left, centers, key, lat, lon, "cluster_id", "cluster_id", km, out, ["mmsi"])
        found, left = got if found is None else found.union(got), left.join(got, key, "left_anti")
    return found.union(nearest(left, centers, key, lat, lon, "cluster_id", "cluster_id", ["mmsi"], out))


def quality(summary: DataFrame, centers: DataFrame, min_duration_s: float = 1800.0, min_distance_km: float = 2.0, spin_deg: float = 360.0, spin_distance_km: float = 2.0,
            cluster_eps_km: float = 1.0, nearby_km: float = 1.0, gap_hours: float = 2.0, turns_per_km: float = 150.0) -> DataFrame:
    """Adds ``valid_flag`` and ``invalid_reason``; the first rule that applies gives the reason.

    ``centers(mmsi, cluster_id, lat, lon)`` are the vessel's stop centres.
    """
    key = list(KEY)
    ends = summary.select(*key, "dep_lat", "dep_lon", "arr_lat", "arr_lon")
    dep = nearest_of_vessel(ends, centers, key, "dep_lat", "dep_lon", "dep_cluster")
    arr = nearest_of_vessel(ends, centers, key, "arr_lat", "arr_lon", "arr_cluster")
    df = summary.join(dep, key, "left").join(arr, key, "left")
    km, turned = F.col("displacement_km"), F.col("heading_cum_deg")
    reason = (
        F.when(F.col("dep_cluster") == F.col("arr_cluster"), "R0_same_cluster")
        .when((F.col("dep_cluster_km") < cluster_eps_km) & (F.col("arr_cluster_km") < cluster_eps_km) & (km < nearby_km), "R1_nearby_clusters")
        .when((F.col("duration_hr") * 3600 < min_duration_s) | (km < min_distance_km), "R2_too_short")
        .when((turned > 0) & (km < spin_distance_km) & (turned >= spin_deg), "R4a_spin_in_place")
        .when((turned > 0) & (F.col("path_len_km") > 0) & (F.try_divide(turned, F.col("path_len_km")) > turns_per_km), "R4b_excessive_turns")
        .when(F.col("max_gap_s") > gap_hours * 3600, "R5_large_time_gap")
    )
    return df.withColumn("invalid_reason", reason).withColumn("valid_flag", F.col("invalid_reason").isNull())


def assign_ports(voyages: DataFrame, ports: DataFrame, max_dist_km: float = 10.0) -> DataFrame:
    """Adds origin_port and destination_port, ``unknown`` beyond ``max_dist_km``, their distances, null beyond, and rule R7."""
    key, df = list(KEY), voyages
    for end, lat, lon in (("origin", "dep_lat", "dep_lon"), ("destination", "arr_lat", "arr_lon")):
        got = nearest_within(voyages.select(*key, lat, lon), ports, key, lat, lon, "port_name", "port_ord", max_dist_km, f"_{end}")
        near = F.when(F.col(f"_{end}_km").isNotNull(), F.col(f"_{end}")).otherwise("unknown")
        df = df.join(got, key, "left").withColumn(f"{end}_port", near).withColumnRenamed(f"_{end}_km", f"{end}_km").drop(f"_{end}")
    lost = ((F.col("origin_port") == "unknown") | (F.col("destination_port") == "unknown")) & F.col("invalid_reason").isNull()
    df = df.withColumn("valid_flag", F.col("valid_flag") & ~lost)
    return df.withColumn("invalid_reason", F.when(lost, "R7_unknown_port").otherwise(F.col("invalid_reason")))


def eta_features(labelled: DataFrame, segments: DataFrame) -> DataFrame:
    """Voyage rows with ``dist_to_dest_km`` to the mean position of the next kept stop, and ``near_port_flag``."""
    kept = segments.where("kept").withColumn("_rank", F.row_number().over(Window.partitionBy("mmsi").orderBy("stop_id")).cast("long"))
    dest = kept.select("mmsi", (F.col("_rank") - 1).alias("voyage_id"), F.col("mean_lat").alias("dest_lat"), lon_from_360("mean_lon_360").alias("dest_lon"))
    df = labelled.where("voyage_id is not null").join(dest, list(KEY), "left")
    df = df.withColumn("dist_to_dest_km", haversine_km("lat", lon_from_360("lon_360"), "dest_lat", "dest_lon"))
    return df.withColumn("near_port_flag", near_port_flag("dist_to_dest_km"))


def time_stats(labelled: DataFrame) -> DataFrame:
    """Start, end, duration, mean interval and whether times never fall, per voyage."""
    df = _steps(labelled).groupBy(*KEY).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.avg("step_s").alias("mean_interval_sec"), F.coalesce(F.min("step_s") >= 0, F.lit(True)).alias("monotonic"))
    return df.withColumn("duration_sec", seconds_between("end_time", "start_time"))


def length_histogram(labelled: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of points per voyage; the last bin holds its right edge."""
    n = labelled.where("voyage_id is not null").groupBy(*KEY).agg(F.count("*").alias("n"))
    lo_hi = n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    df = n.join(F.broadcast(lo_hi)).withColumn("bin", F.least(F.floor((F.col("n") - F.col("lo")) / width).cast("long"), F.lit(bins - 1).cast("long")))
    return df.groupBy("bin").agg(F.count("*").alias("voyages"))
