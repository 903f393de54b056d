"""Registered queries, on the tracks shaped from ``events``, and the SQL that must give the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import clusters, models, sequences, stops, voyages
from wakeline.plans import oracle as sql
from wakeline.plans import pipelines
from wakeline.sources import ais

QUERIES: dict = {}
ORACLE: dict = {}

PORTS = [("P0", 25.15, 121.75), ("P1", 25.195, 121.78), ("P2", 24.20, 120.50), ("P3", 22.60, 120.28)]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles to six decimals: sums of doubles depend on their order."""
    kind = dict(df.dtypes)
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if kind[c] == "double" else F.col(c) for c in columns))


def _ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p, i) for i, p in enumerate(PORTS)], "port_name string, lat double, lon double, port_ord long")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    e = ais.from_events(spark, d)
    return e.select("row_ord", F.col("mmsi").alias("MMSI"), F.col("lat").alias("Lat"), F.col("lon").alias("Lng"), F.col("sog").alias("Sog"), F.col("ts").alias("Timestamp"), F.col("heading").alias("Hdg"))


@query(sql.AIS + "SELECT mmsi, row_ord, ts, round(lat, 6) AS lat, round(lon, 6) AS lon, round(lon_360, 6) AS lon_360, sog, heading FROM ais")
def ais_clean(spark, d):
    df = ais.clean(_raw(spark, d))
    return df.select("mmsi", "row_ord", "ts", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "lon_360")), "sog", "heading")


@query(sql.AIS + "SELECT CAST(avg(CASE WHEN mmsi = 416000000 THEN 1.0::DOUBLE ELSE 0 END) AS DOUBLE) AS valid_ratio FROM (SELECT CASE WHEN lat BETWEEN -90 AND 90 THEN mmsi END AS mmsi FROM ais)")
def valid_ratio(spark, d):
    return _raw(spark, d).agg(F.avg(F.when(F.col("MMSI") == 416000000, 1.0).otherwise(0.0)).alias("valid_ratio"))


@query(sql.AIS + "SELECT row_ord, CASE WHEN ts > TIMESTAMP '2024-01-15 10:58:10' THEN round(sog / 10, 6) ELSE sog END AS sog FROM ais")
def sog_unit_repair(spark, d):
    cut = "2024-01-15 10:58:10"
    late = F.col("ts") > F.lit(cut).cast("timestamp_ntz")
    df = ais.repair_sog(ais.from_events(spark, d), cut)
    return df.select("row_ord", F.when(late, F.round("sog", 6)).otherwise(F.col("sog")).alias("sog"))


@query(sql.AIS + f"SELECT row_ord, round({sql.hav('lat', 'lon', '25.15::DOUBLE', '121.75::DOUBLE')}, 6) AS km, round({sql.hav('lat', 'lon', '25.15::DOUBLE', '121.75::DOUBLE', '6371.0::DOUBLE')}, 6) AS km_atan2, round({sql.hav('lat', 'lon', '25.15::DOUBLE', '121.75::DOUBLE', '1::DOUBLE')}, 9) AS rad FROM ais")
def haversine_pairs(spark, d):
    p = ais.from_events(spark, d)
    to = ("lat", "lon", F.lit(25.15), F.lit(121.75))
    return p.select("row_ord", F.round(geo.haversine_km(*to), 6).alias("km"), F.round(geo.haversine_atan2_km(*to), 6).alias("km_atan2"), F.round(geo.haversine_rad(*to), 9).alias("rad"))


@query(sql.AIS + "SELECT row_ord, round(((x % 360) + 360) % 360, 6) AS lon_360, round((((x + 180) % 360) + 360) % 360 - 180, 6) AS lon_180, round(CASE WHEN lon_360 * 2 > 180 THEN lon_360 * 2 - 360 ELSE lon_360 * 2 END, 6) AS folded FROM (SELECT *, (heading - 256) * 2.5::DOUBLE AS x FROM ais)")
def lon_wrap(spark, d):
    x = (F.col("heading") - 256) * 2.5
    p = ais.from_events(spark, d)
    return p.select("row_ord", F.round(geo.lon_360(x), 6).alias("lon_360"), F.round(geo.lon_180(x), 6).alias("lon_180"), F.round(geo.lon_from_360(F.col("lon_360") * 2), 6).alias("folded"))


@query(sql.TRACK + "SELECT mmsi, idx, round(time_diff, 6) AS time_diff, round(lat_diff, 9) AS lat_diff, round(lon_diff, 9) AS lon_diff, round(lat_rate, 9) AS lat_diff_rate, round(lon_rate, 9) AS lon_diff_rate FROM delta")
def track_deltas(spark, d):
    df = stops.deltas(stops.ordered(ais.from_events(spark, d)))
    return df.select("mmsi", "idx", F.round("time_diff", 6).alias("time_diff"), *(F.round(c, 9).alias(c) for c in ("lat_diff", "lon_diff", "lat_diff_rate", "lon_diff_rate")))


@query(sql.TRACK + "SELECT mmsi, count(time_diff) AS n, round(avg(time_diff), 6) AS mean, round(stddev_samp(time_diff), 6) AS std, round(min(time_diff), 6) AS lowest, round(quantile_cont(time_diff, 0.25), 6) AS q25, round(quantile_cont(time_diff, 0.5), 6) AS q50, round(quantile_cont(time_diff, 0.75), 6) AS q75, round(max(time_diff), 6) AS highest FROM delta GROUP BY mmsi")
def time_gap_stats(spark, d):
    x = F.col("time_diff")
    df = stops.deltas(stops.ordered(ais.from_events(spark, d))).groupBy("mmsi").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lowest"),
        *(F.percentile(x, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.max(x).alias("highest"),
    )
    return _rounded(df, *df.columns)


@query(sql.marked("a") + "SELECT mmsi, idx, is_stop, CAST(stop_id AS BIGINT) AS stop_id FROM marked")
def stop_points_a(spark, d):
    return stops.sessions(stops.slow_only(stops.ordered(ais.from_events(spark, d)))).select("mmsi", "idx", "is_stop", "stop_id")


@query(sql.marked("b") + "SELECT mmsi, idx, is_stop, CAST(stop_id AS BIGINT) AS stop_id FROM marked")
def stop_points_b(spark, d):
    return stops.sessions(stops.slow_and_still(stops.ordered(ais.from_events(spark, d)))).select("mmsi", "idx", "is_stop", "stop_id")


_SEGMENTS = "SELECT mmsi, CAST(stop_id AS BIGINT) AS stop_id, first_idx, last_idx, start_ts, end_ts, n_points, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(r95_km, 6) AS r95_km, round(duration_s, 6) AS duration_s, kept FROM segments"


def _segments(spark, d, variant):
    t = pipelines.track(ais.from_events(spark, d), variant)
    return _rounded(t.segments, "mmsi", "stop_id", "first_idx", "last_idx", "start_ts", "end_ts", "n_points", "center_lat", "center_lon", "r95_km", "duration_s", "kept")


@query(sql.labelled("a") + _SEGMENTS)
def stop_segments_a(spark, d):
    return _segments(spark, d, "a")


@query(sql.labelled("b") + _SEGMENTS)
def stop_segments_b(spark, d):
    return _segments(spark, d, "b")


@query(sql.labelled("a") + "SELECT mmsi, idx, CAST(voyage_id AS BIGINT) AS voyage_id, round(real_eta_sec, 6) AS real_eta_sec FROM labelled")
def voyage_points_eta(spark, d):
    return _rounded(pipelines.track(ais.from_events(spark, d)).points, "mmsi", "idx", "voyage_id", "real_eta_sec")


@query(sql.summary("a") + "SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, start_idx, end_idx, dep_time, arr_time, round(duration_hr, 6) AS duration_hr, round(displacement_km, 6) AS displacement_km, round(path_len_km, 6) AS path_len_km, round(heading_cum_deg, 6) AS heading_cum_deg, n_points FROM summary")
def voyages_summary(spark, d):
    df = voyages.summarise(pipelines.track(ais.from_events(spark, d)).points)
    return _rounded(df, "mmsi", "voyage_id", "start_idx", "end_idx", "dep_time", "arr_time", "duration_hr", "displacement_km", "path_len_km", "heading_cum_deg", "n_points")


@query(sql.summary("a") + "SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, coalesce(max_gap_s > 7200, false) AS large_gap FROM summary")
def voyage_gaps(spark, d):
    return voyages.large_gap(pipelines.track(ais.from_events(spark, d)).points)


@query(sql.summary("a") + "SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, dep_time AS start_time, arr_time AS end_time, round(mean_gap, 3) AS mean_interval_sec, coalesce(min_gap >= 0, true) AS monotonic, round(duration_hr * 3600, 6) AS duration_sec FROM summary")
def voyage_time_stats(spark, d):
    # Means of microseconds often end in half a microsecond, which engines round differently; milliseconds rarely tie.
    df = voyages.time_stats(pipelines.track(ais.from_events(spark, d)).points).withColumn("mean_interval_sec", F.round("mean_interval_sec", 3))
    return _rounded(df, "mmsi", "voyage_id", "start_time", "end_time", "mean_interval_sec", "monotonic", "duration_sec")


@query(sql.summary("a") + ", b AS (SELECT min(n_points) AS lo, max(n_points) AS hi FROM summary) SELECT CAST(least(floor((n_points - lo) / CASE WHEN hi > lo THEN (hi - lo)::DOUBLE / 50 ELSE 0.02::DOUBLE END), 49) AS BIGINT) AS bin, count(*) AS voyages FROM summary, b GROUP BY 1")
def voyage_length_hist(spark, d):
    return voyages.length_histogram(pipelines.track(ais.from_events(spark, d)).points)


@query(sql.centers() + "SELECT mmsi, CAST(cluster_id AS INTEGER) AS cluster_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM centers")
def stop_centers(spark, d):
    df = clusters.stop_centers(pipelines.track(ais.from_events(spark, d)).points)
    return _rounded(df, "mmsi", "cluster_id", "lat", "lon")


@query(sql.quality() + "SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, invalid_reason IS NULL AS valid_flag, invalid_reason FROM judged")
def voyage_quality(spark, d):
    return pipelines.run_voyages(ais.from_events(spark, d)).select("mmsi", "voyage_id", "valid_flag", "invalid_reason")


_VOYAGE = (
    "SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, start_idx, end_idx, dep_time, arr_time, round(duration_hr, 6) AS duration_hr, round(displacement_km, 6) AS displacement_km, "
    "round(path_len_km, 6) AS path_len_km, round(heading_cum_deg, 6) AS heading_cum_deg, n_points, reason IS NULL AS valid_flag, reason AS invalid_reason, round(dep_lat, 6) AS dep_lat, "
    "round(dep_lon, 6) AS dep_lon, round(arr_lat, 6) AS arr_lat, round(arr_lon, 6) AS arr_lon, origin_port, destination_port FROM ported"
)


@query(sql.ported(PORTS) + _VOYAGE)
def voyages_with_ports(spark, d):
    df = pipelines.run_voyages(ais.from_events(spark, d), _ports(spark))
    return _rounded(df, *pipelines.COLUMNS)


@query(sql.ported(PORTS) + "SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, o.n AS port_name, round(o.d, 6) AS km FROM ported")
def nearest_port(spark, d):
    ends = voyages.summarise(pipelines.track(ais.from_events(spark, d)).points)
    df = voyages.nearest(ends, _ports(spark), ["mmsi", "voyage_id"], "dep_lat", "dep_lon", "port_name", "port_ord", [], "port_name")
    return _rounded(df.withColumnRenamed("port_name_km", "km"), "mmsi", "voyage_id", "port_name", "km")


QUERIES["voyages"], ORACLE["voyages"] = QUERIES["voyages_with_ports"], ORACLE["voyages_with_ports"]


@query(sql.features() + "SELECT mmsi, idx, CAST(voyage_id AS BIGINT) AS voyage_id, round(dist_to_dest_km, 6) AS dist_to_dest_km, near_port_flag, round(real_eta_sec, 6) AS real_eta_sec FROM features")
def eta_features(spark, d):
    return _rounded(pipelines.eta_rows(ais.from_events(spark, d), "a"), "mmsi", "idx", "voyage_id", "dist_to_dest_km", "near_port_flag", "real_eta_sec")


def _chunks(spark, d, longest=100):
    return sequences.chunks(pipelines.eta_rows(ais.from_events(spark, d), "a"), longest)


@query(sql.chunked(100) + "SELECT mmsi, idx, CAST(voyage_id AS BIGINT) AS voyage_id, chunk, segment_id FROM chunked")
def segment_chunks(spark, d):
    return _chunks(spark, d).select("mmsi", "idx", "voyage_id", "chunk", "segment_id")


_STD = ", ".join(f"round(coalesce(({c} - avg({c}) OVER s) / nullif(stddev_pop({c}) OVER s, 0), 0), 5) + 0.0::DOUBLE AS {c}_std" for c in sequences.FEATURES)


@query(sql.chunked(100) + f"SELECT mmsi, idx, segment_id, {_STD} FROM chunked WINDOW s AS (PARTITION BY segment_id)")
def segment_standardized(spark, d):
    df = sequences.standardised(_chunks(spark, d))
    return df.select("mmsi", "idx", "segment_id", *((F.round(f"{c}_std", 5) + 0.0).alias(f"{c}_std") for c in sequences.FEATURES))


@query(sql.chunked(100) + "SELECT segment_id, CAST(count(*) AS INTEGER) AS length, (SELECT CAST(max(n) AS INTEGER) FROM (SELECT count(*) AS n FROM chunked GROUP BY segment_id)) AS padded_to, round(sum(real_eta_sec::FLOAT::DOUBLE), 2) AS y_sum FROM chunked GROUP BY segment_id HAVING count(*) >= 3")
def padded_sequences(spark, d):
    df = sequences.padded(sequences.standardised(_chunks(spark, d)))
    total = F.aggregate("y", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return df.select("segment_id", "length", F.size("x").alias("padded_to"), F.round(total, 2).alias("y_sum"))


@query(sql.windows(20, 10) + "SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, window_id, CAST(20 AS INTEGER) AS length, round(y, 6) AS y, round(first_lat::FLOAT::DOUBLE, 4) AS first_lat FROM windowed")
def sliding_windows(spark, d):
    df = sequences.windows(pipelines.eta_rows(ais.from_events(spark, d), "a"), 20, 10)
    return df.select("mmsi", "voyage_id", "window_id", F.size("x").alias("length"), F.round("y", 6).alias("y"), F.round(F.col("x")[0][0].cast("double"), 4).alias("first_lat"))


@query(sql.ports_stage1() + "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(radius_km, 6) AS radius_km, num_points FROM stage1")
def ports_stage1(spark, d):
    slow = ais.slow(ais.from_events(spark, d))
    return _rounded(clusters.first_stage(slow)[1], "cluster_id", "center_lat", "center_lon", "radius_km", "num_points")


@query(sql.ports_merged() + "SELECT CAST(port_id AS INTEGER) AS port_id, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(radius_km, 6) AS radius_km, num_points FROM ports")
def ports_merged(spark, d):
    return _rounded(pipelines.detect_ports(ais.from_events(spark, d)), "port_id", "center_lat", "center_lon", "radius_km", "num_points")


@query(sql.ports_maxradius() + "SELECT mmsi, CAST(cluster_id AS INTEGER) AS cluster_id, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(radius_km, 6) AS radius_km, num_points FROM ports")
def ports_maxradius(spark, d):
    df = clusters.one_stage_ports(ais.from_events(spark, d), ["mmsi"], eps=0.0005)
    return _rounded(df, "mmsi", "cluster_id", "center_lat", "center_lon", "radius_km", "num_points")


@query(sql.ports_maxradius("0.01") + "SELECT mmsi, CAST(cluster_id AS INTEGER) AS cluster_id, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(radius_km, 6) AS radius_km, num_points FROM ports")
def ports_maxradius_wide(spark, d):
    df = clusters.one_stage_ports(ais.from_events(spark, d), ["mmsi"])
    return _rounded(df, "mmsi", "cluster_id", "center_lat", "center_lon", "radius_km", "num_points")


@query(sql.ports_maxradius("0.001", "lon_360") + "SELECT mmsi, CAST(cluster_id AS INTEGER) AS cluster_id, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(radius_km, 6) AS radius_km, num_points FROM ports")
def ports_maxradius_360(spark, d):
    df = clusters.one_stage_ports(ais.from_events(spark, d), ["mmsi"], eps=0.001, lon="lon_360")
    return _rounded(df, "mmsi", "cluster_id", "center_lat", "center_lon", "radius_km", "num_points")


@query(sql.quality() + "SELECT mmsi, count(*) AS voyages, count(*) FILTER (invalid_reason IS NULL) AS valid_voyages FROM judged GROUP BY mmsi")
def valid_voyages(spark, d):
    return pipelines.valid_voyages(pipelines.run_voyages(ais.from_events(spark, d)))


@query(sql.AIS + "SELECT 'lat' AS what, count(*) AS n, round(avg(lat), 6) AS mean, round(stddev_samp(lat), 6) AS std, round(min(lat), 6) AS lowest, round(quantile_cont(lat, 0.25), 6) AS q25, round(quantile_cont(lat, 0.5), 6) AS q50, round(quantile_cont(lat, 0.75), 6) AS q75, round(max(lat), 6) AS highest FROM ais UNION ALL SELECT 'lon', count(*), round(avg(lon), 6), round(stddev_samp(lon), 6), round(min(lon), 6), round(quantile_cont(lon, 0.25), 6), round(quantile_cont(lon, 0.5), 6), round(quantile_cont(lon, 0.75), 6), round(max(lon), 6) FROM ais")
def position_stats(spark, d):
    p = ais.from_events(spark, d).select(F.explode(F.create_map(F.lit("lat"), "lat", F.lit("lon"), "lon")).alias("what", "x"))
    x = F.col("x")
    df = p.groupBy("what").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lowest"),
        *(F.percentile(x, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.max(x).alias("highest"),
    )
    return _rounded(df, *df.columns)


@query(sql.labelled("a") + ", own AS (SELECT mmsi, voyage_id, count(*) AS points FROM labelled WHERE voyage_id IS NOT NULL GROUP BY mmsi, voyage_id) SELECT points, count(*) AS voyages FROM own GROUP BY points")
def voyage_size_counts(spark, d):
    p = pipelines.track(ais.from_events(spark, d)).points.where("voyage_id is not null")
    return p.groupBy("mmsi", "voyage_id").agg(F.count("*").alias("points")).groupBy("points").agg(F.count("*").alias("voyages"))


@query(sql.chunked(500) + "SELECT count(DISTINCT segment_id) AS segments, count(*) AS points FROM chunked")
def segment_count(spark, d):
    return _chunks(spark, d, 500).agg(F.count_distinct("segment_id").alias("segments"), F.count("*").alias("points"))


_WINDOW_X = ", ".join(f"round(avg({c}::FLOAT::DOUBLE), 4) AS mean_{c}" for c in sequences.WINDOW_FEATURES)


@query(sql.windows(50, 25) + f", held AS (SELECT w.mmsi, w.voyage_id, w.window_id, w.y, m.lat, m.lon_360, m.sog, m.heading FROM windowed w JOIN moving m ON m.mmsi = w.mmsi AND m.voyage_id = w.voyage_id AND m.rn BETWEEN w.window_id * 25 AND w.window_id * 25 + 49) SELECT mmsi, CAST(voyage_id AS BIGINT) AS voyage_id, window_id, CAST(count(*) AS INTEGER) AS length, round(any_value(y), 6) AS y, {_WINDOW_X} FROM held GROUP BY mmsi, voyage_id, window_id")
def sliding_windows_50(spark, d):
    """Windows of the reference size; every feature of every row takes part in the means."""
    df = sequences.windows(pipelines.eta_rows(ais.from_events(spark, d), "a"))
    mean = lambda i: F.aggregate("x", F.lit(0.0).cast("double"), lambda a, r: a + r[i].cast("double"), lambda a: a / F.size("x"))
    means = [F.round(mean(i), 4).alias(f"mean_{c}") for i, c in enumerate(sequences.WINDOW_FEATURES)]
    return df.select("mmsi", "voyage_id", "window_id", F.size("x").alias("length"), F.round("y", 6).alias("y"), *means)


@query()
def rf_eta_metrics(spark, d):
    return pipelines.run_eta(ais.from_events(spark, d)).metrics


@query()
def rf_importance(spark, d):
    return pipelines.run_eta(ais.from_events(spark, d)).importances


@query()
def eta_point(spark, d):
    model = pipelines.run_eta(ais.from_events(spark, d)).model
    return models.eta_point(spark, model, 25.154453, 121.377811, 11.8, 25.1384, 121.7476, "2025-07-25 00:00:00")


@query()
def lstm_sequence_metrics(spark, d):
    return pipelines.run_sequence_eta(ais.from_events(spark, d)).metrics


@query()
def lstm_window_metrics(spark, d):
    return pipelines.run_window_eta(ais.from_events(spark, d)).metrics


@query()
def lstm_window_history(spark, d):
    return pipelines.run_window_eta(ais.from_events(spark, d)).history
