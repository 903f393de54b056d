import datetime as dt
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import clusters, stops, voyages
from wakeline.plans import catalog
from wakeline.sources import ais

T0 = dt.datetime(2024, 1, 1)
POINT = "mmsi long, row_ord long, ts timestamp_ntz, lat double, lon double, lon_360 double, sog double, heading double"


def points(spark, rows):
    """Rows (seconds, sog[, lat, lon, heading]) of one vessel."""
    out = []
    for i, r in enumerate(rows):
        lat, lon, heading = (*r[2:], *(10.0, 20.0, None)[len(r) - 2 :])
        out.append((1, i, T0 + dt.timedelta(seconds=r[0]), lat, lon, lon % 360, r[1], heading))
    return spark.createDataFrame(out, POINT)


def stop_ids(spark, rows):
    df = stops.sessions(stops.slow_only(stops.ordered(points(spark, rows))))
    return [r.stop_id for r in df.orderBy("idx").collect()]


def test_gap_is_strict(spark):
    assert stop_ids(spark, [(0, 0.1), (120, 5.0), (130, 0.1)]) == [1, 1, 1]
    assert stop_ids(spark, [(0, 0.1), (121, 5.0), (130, 0.1)]) == [1, None, 2]


def test_bare_gap_and_tail(spark):
    assert stop_ids(spark, [(0, 0.1), (36000, 0.1), (36010, 9.0)]) == [1, 1, None]
    assert stop_ids(spark, [(0, 9.0), (10, None), (20, 0.1)]) == [None, None, 1]


def test_sessions_match_a_sequential_model(spark):
    rng = random.Random(5)
    for _ in range(3):
        t, rows = 0, []
        for _ in range(300):
            t += rng.choice([10, 60, 119, 120, 121, 300])
            rows.append((t, rng.choice([0.1, 0.1, 5.0])))
        want, ranges, start, last = [None] * len(rows), [], None, None
        for i, (s, sog) in enumerate(rows):
            if sog < 0.5:
                start, last = (i if start is None else start), i
            elif start is not None and s - rows[last][0] > 120:
                ranges.append((start, last))
                start = last = None
        if start is not None:
            ranges.append((start, last))
        for n, (a, b) in enumerate(ranges):
            want[a : b + 1] = [n + 1] * (b - a + 1)
        assert stop_ids(spark, rows) == want


def test_wraps_and_flags(spark):
    df = spark.createDataFrame([(-10.5,), (180.0,), (-180.0,), (359.9,)], "x double")
    got = [(round(r[0], 6), round(r[1], 6), round(r[2], 6)) for r in df.select(geo.lon_360("x"), geo.lon_180("x"), geo.lon_from_360("x")).collect()]
    assert got == [(349.5, -10.5, -10.5), (180.0, -180.0, 180.0), (180.0, -180.0, -180.0), (359.9, -0.1, -0.1)]
    d = spark.createDataFrame([(0.999,), (1.0,), (5.0,), (5.001,), (None,)], "d double")
    assert [r[0] for r in d.select(geo.near_port_flag("d")).collect()] == [1.0, 0.5, 0.5, 0.0, None]
    assert d.select(geo.haversine_km("d", F.lit(0.0), F.lit(0.0), F.lit(0.0))).collect()[4][0] is None


def test_heading(spark):
    rows = [(i * 60, 9.0, 10.0, 20.0, h) for i, h in enumerate([350.0, 10.0, 511.0, None, 190.0])]
    df = stops.ordered(points(spark, rows)).withColumn("voyage_id", F.lit(1))
    assert voyages.heading_cum(df).first().heading_cum_deg == 200.0


def test_cleaning(spark):
    raw = spark.createDataFrame([(s,) for s in ("", "abc", "1.5d", "nan", "inf", " 1.5 ", "1e3")], "x string")
    assert [r[0] for r in raw.select(ais.number("x")).collect()] == [None, None, None, None, math.inf, 1.5, 1000.0]
    t = spark.createDataFrame([("20250711081924",), ("2025-07-11 08:19:24",), ("junk",), (None,)], "t string")
    same = dt.datetime(2025, 7, 11, 8, 19, 24)
    assert [r[0] for r in t.select(ais.timestamp("t")).collect()] == [same, same, None, None]
    with pytest.raises(ValueError):
        ais.resolve_aliases(raw)


def brute_dbscan(pts, eps, m, pick):
    def near(a, b):
        p, q = (tuple(map(math.radians, x)) for x in (a, b))
        h = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
        return 2 * math.asin(math.sqrt(min(1, h))) <= eps

    nb = [[j for j in range(len(pts)) if near(pts[i], pts[j])] for i in range(len(pts))]
    core, label, c = [len(n) >= m for n in nb], [-1] * len(pts), 0
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                x = todo.pop()
                if label[x] < 0:
                    label[x] = c
                    todo += [y for y in nb[x] if core[y]]
            c += 1
    return [label[i] if core[i] else pick([label[j] for j in nb[i] if core[j]] or [-1]) for i in range(len(pts))]


@pytest.mark.parametrize("mode,border", [("grid", "last"), ("exact", "first")])
def test_dbscan(spark, mode, border):
    rng = random.Random(3)
    pts = [(round(rng.uniform(-0.6, 0.6), 1), round(rng.uniform(-0.6, 0.6), 1)) for _ in range(70)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "row_ord long, lat double, lon double")
    got = [r.cluster_id for r in clusters.dbscan(df, 0.0021, 4, mode=mode, border=border).orderBy("row_ord").collect()]
    assert got == brute_dbscan(pts, 0.0021, 4, max if border == "last" else min)


def test_high_latitude(spark):
    df = spark.createDataFrame([(0, 70.0, 0.0), (1, 70.0, 2.5)], "row_ord long, lat double, lon double")
    eps = math.radians(1.0)
    assert {r.cluster_id for r in clusters.dbscan(df, eps, 2).collect()} == {-1}
    assert {r.cluster_id for r in clusters.dbscan(df, eps, 2, mode="exact").collect()} == {0}


def test_merge_of_centers_that_change(spark):
    """Averages over a shuffle differ in their last bits each time they are computed; no cluster may get lost by that."""
    rows = [(c, 20.0 + c // 2 * 3 + c % 2 * 0.004, 120.0) for c in range(6) for _ in range(3)]
    members = spark.createDataFrame(rows, "cluster_id int, lat double, lon double")
    noise = F.udf(lambda x: x + int.from_bytes(os.urandom(4), "big") * 1e-19 * x, "double").asNondeterministic()
    centers = members.dropDuplicates().select("cluster_id", noise("lat").alias("center_lat"), F.col("lon").alias("center_lon"))
    got = [(r.port_id, round(r.center_lat, 6), r.num_points) for r in clusters.merge(members, centers).orderBy("port_id").collect()]
    assert got == [(0, 20.002, 6), (1, 23.002, 6), (2, 26.002, 6)]


def test_empty_track(spark):
    from wakeline.plans import pipelines

    assert pipelines.run_voyages(points(spark, [])).columns == pipelines.COLUMNS[:-2]
    assert pipelines.run_voyages(points(spark, [(0, 0.1), (10, 0.1)])).count() == 0


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE) - {"voyages"}))
def test_oracle(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    got = catalog.QUERIES[name](spark, d)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(cols).collect())


def test_files_in_and_out(spark, tmp_path):
    """Positions and ports from CSV, one vessel taken, voyages and ports to CSV and maps."""
    from wakeline.plans import pipelines
    from wakeline.sources import sinks

    def leg(t0, lat, lon, n, sog, to=None):
        return [(t0 + 300 * i, lat + (to[0] - lat) * i / n if to else lat, lon + (to[1] - lon) * i / n if to else lon, sog) for i in range(n)]

    rows = leg(0, 25.15, 121.75, 20, 0.1) + leg(6000, 25.15, 121.75, 30, 12.0, (24.2, 120.5)) + leg(15_000, 24.2, 120.5, 20, 0.1)
    lines = ["MMSI,Long,Lat,Sog,Hdg,Timestamp"] + [f"7,{o},{a},{s},{90 + i % 7},{(T0 + dt.timedelta(seconds=t)).isoformat(sep=' ')}" for i, (t, a, o, s) in enumerate(rows)]
    lines += ["8,1,1,0.1,1,2024-01-01 00:00:00", "7,999,1,0.1,1,2024-01-01 00:00:00", "7,1,1,,1,2024-01-01 00:00:00", "7,1,1,0.1,1,junk", "7,x,1,0.1,1,2024-01-01 00:00:00"]
    (tmp_path / "p.csv").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "ports.csv").write_text("name,lat,lon\nA,25.15,121.75\nB,24.2,120.5\n", encoding="utf-8")
    raw = ais.read_csv(spark, str(tmp_path / "p.csv"))
    points = ais.clean(raw, mmsi=7)
    assert points.count() == len(rows) and ais.clean(raw, mmsi=7, keep_missing_sog=True).count() == len(rows) + 1 and ais.clean(raw).count() == len(rows) + 1
    assert ais.clean(raw, mmsi=7, sog_range=(1, 50)).count() == 30
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ais.clean(raw, mmsi=7, strict=True).collect()
    out = pipelines.run_voyages(points, ais.read_ports(spark, str(tmp_path / "ports.csv")))
    assert sinks.write_csv_bom(out, str(tmp_path / "out.csv")) == 1
    data = (tmp_path / "out.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and data[3:].decode().splitlines()[0].split(",") == pipelines.COLUMNS
    r = out.first()
    assert (r.origin_port, r.destination_port, r.valid_flag, r.n_points) == ("A", "B", True, 30)
    t = pipelines.track(points)
    assert pipelines.valid_voyages(out).first().valid_voyages == 1
    page = open(sinks.voyage_map(t.points, out, str(tmp_path / "v.html"), most=10), encoding="utf-8").read()
    assert all(x in page for x in ('"color": "blue"', '"icon": "play"', '"icon": "stop"', "Valid=True")) and page.count("25.15") < 20
    ports = pipelines.detect_ports(points)
    assert sinks.write_ports_csv(ports, str(tmp_path / "found")) and not sinks.write_ports_csv(ports.where("false"), str(tmp_path / "none"))
    assert '"anchor"' in open(sinks.port_map(ports, str(tmp_path / "ports.html")), encoding="utf-8").read() and sinks.port_map(ports.where("false"), str(tmp_path / "x")) is None
    assert "Start" in open(sinks.track_map(points, str(tmp_path / "t.html"), 5), encoding="utf-8").read()


def test_spin_in_place(spark):
    """Rules of quality in order, on made summaries; the spin needs a short way and a full turn."""
    kind = "mmsi long, voyage_id long, duration_hr double, displacement_km double, path_len_km double, heading_cum_deg double, max_gap_s double, dep_lat double, dep_lon double, arr_lat double, arr_lon double"
    row = lambda i, hr, km, path, deg, gap: (1, i, hr, km, path, deg, gap, 10.0, 20.0, 30.0, 40.0)
    df = spark.createDataFrame([row(1, 1.0, 1.5, 9.0, 400.0, 0.0), row(2, 1.0, 50.0, 60.0, 9001.0, 0.0), row(3, 1.0, 50.0, 60.0, 100.0, 7201.0), row(4, 0.4, 50.0, 60.0, 0.0, 0.0), row(5, 1.0, 50.0, 60.0, 0.0, 7200.0)], kind)
    centers = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 1, 30.0, 40.0), (2, 0, 10.0, 20.0)], "mmsi long, cluster_id int, lat double, lon double")
    got = lambda **how: {r.voyage_id: r.invalid_reason for r in voyages.quality(df, centers, **how).collect()}
    assert got() == {1: "R2_too_short", 2: "R4b_excessive_turns", 3: "R5_large_time_gap", 4: "R2_too_short", 5: None}
    assert got(min_distance_km=1.0)[1] == "R4a_spin_in_place"


def test_nearest_of_vessel_agrees_with_all_pairs(spark):
    rng = random.Random(10)
    centers = spark.createDataFrame([(i % 3, i, rng.uniform(20, 22), rng.uniform(120, 124)) for i in range(40)] + [(7, 0, -80.0, 179.0)], "mmsi long, cluster_id int, lat double, lon double")
    ends = spark.createDataFrame([(i % 4 if i else 7, i, rng.uniform(19, 23), rng.uniform(118, 126)) for i in range(200)], "mmsi long, voyage_id long, a double, o double")
    key = ["mmsi", "voyage_id"]
    want = voyages.nearest(ends, centers, key, "a", "o", "cluster_id", "cluster_id", ["mmsi"], "c")
    assert sorted(map(repr, voyages.nearest_of_vessel(ends, centers, key, "a", "o", "c").collect())) == sorted(map(repr, want.collect()))


def test_nearest_within_agrees_with_all_pairs(spark):
    rng = random.Random(9)
    ports = spark.createDataFrame([(f"p{i}", rng.uniform(-89, 89), rng.uniform(-180, 180), i) for i in range(60)] + [("twin", 10.0, 179.99, 70), ("late twin", 10.0, 179.99, 71)], "port_name string, lat double, lon double, port_ord long")
    ends = spark.createDataFrame([(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(900, 10.0, -179.99), (901, None, 3.0)], "k long, a double, o double")
    for km in (10.0, 900.0, 30_000.0):
        want = {r.k: (r.n, r.n_km) for r in voyages.nearest(ends, ports, ["k"], "a", "o", "port_name", "port_ord", [], "n").collect() if r.n_km is not None and r.n_km <= km}
        got = {r.k: (r.n, r.n_km) for r in voyages.nearest_within(ends, ports, ["k"], "a", "o", "port_name", "port_ord", km, "n").collect()}
        assert got == want and got[900][0] == "twin"


def test_recurrent_gradients():
    import numpy as np

    from wakeline.operators import recurrent

    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(3, 5, 2)), np.array([[0, 0, 1, 1, 1], [1] * 5, [0, 1, 1, 1, 1]], dtype=bool)
    for every, y in ((True, rng.normal(size=(3, 5))), (False, rng.normal(size=(3, 1)))):
        model = recurrent.Recurrent(recurrent.initial(2, 4, 1), every, 0.0, 1.0, [])
        _, grads = model.gradients(x, mask, y)
        for name, w in model.params.items():
            for at in list(np.ndindex(w.shape))[::3]:
                kept = w[at]
                up, down = (model.gradients(x, mask, y)[0] for w[at] in (kept + 1e-5, kept - 1e-5))
                w[at] = kept
                assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_recurrent_learns_and_predicts(spark):
    import numpy as np

    from wakeline.operators import recurrent

    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        n = int(rng.integers(3, 9))
        v = rng.normal(size=n)
        rows.append((i, n, [[0.0]] * (8 - n) + [[float(a)] for a in v], [0.0] * (8 - n) + [float(1000 + 50 * s) for s in np.cumsum(v)]))
    df = spark.createDataFrame(rows, "segment_id long, length int, x array<array<float>>, y array<float>")
    model = recurrent.fit_sequences(df, units=16, epochs=40, rate=0.01)
    steps = recurrent.steps_of(recurrent.predict(df, model)).collect()
    assert len(steps) == sum(r[1] for r in rows) and model.history[-1][1] < 0.2 * model.history[0][1]
    assert np.mean([abs(r.y - r.prediction) for r in steps]) == pytest.approx(model.losses(*(lambda g: (recurrent._arrays([r[2] for r in g]), recurrent._steps(np.array([r[1] for r in g]), 8), np.array([r[3] for r in g])))(rows))[1], rel=1e-3)
    last = df.selectExpr("segment_id as mmsi", "1L as voyage_id", "1L as window_id", "x", "cast(y[7] as double) as y")
    whole = recurrent.fit_windows(last, units=16, epochs=40, rate=0.01)
    assert whole.history[-1][1] < 0.3 * whole.history[0][1] and recurrent.predict(last, whole).where("prediction is not null").count() == 120
    assert recurrent.fit_windows(last.limit(0)) is None and recurrent.fit_sequences(df.limit(0)) is None


def test_streamed_stops_match_the_batch(spark, tmp_path):
    from wakeline.streaming.stops import stop_stream

    rng, t, rows = random.Random(11), 0, []
    for i in range(400):
        t += rng.choice([10, 60, 119, 120, 121, 300])
        rows.append((t, rng.choice([0.1, 0.1, 0.1, 5.0, None]), 10 + rng.random() / 500, 20 + rng.random() / 500, None))
    rows += [(t + 86_400, 9.0, 10.0, 20.0, None), (t + 2 * 86_400, 9.0, 10.0, 20.0, None), (t + 3 * 86_400, 9.0, 10.0, 20.0, None)]
    batch = points(spark, rows)
    want = stops.segments(stops.sessions(stops.slow_only(stops.ordered(batch))))
    src = batch.select("mmsi", "row_ord", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon", "sog").toPandas()
    for n in range(6):  # every part but the last two holds late reports of the part before
        part = src.iloc[max(0, n * 80 - 1) : (n + 1) * 80 - 1] if n < 5 else src.iloc[399:]
        parts = [part] if n < 5 else [src.iloc[[k]] for k in range(399, len(src))]
        for k, one in enumerate(parts):
            out = spark.createDataFrame(one.sample(frac=1, random_state=n), "mmsi long, row_ord long, ts timestamp, lat double, lon double, sog double")
            out.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi long, row_ord long, ts timestamp, lat double, lon double, sog double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stop_stream(stream).writeStream.format("memory").queryName("stops_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    columns = ["stop_id", "start_ts", "end_ts", "n_points", "kept"]
    got = spark.table("stops_out")
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    both = got.join(want.select("stop_id", F.col("r95_km").alias("w"), F.col("center_lat").alias("c")), "stop_id").collect()
    assert len(both) > 5 and all(r.r95_km == pytest.approx(r.w) and r.center_lat == pytest.approx(r.c) for r in both)


def test_registered_fits_are_whole(spark, monkeypatch):
    """The queries for the regressors fit with the operators' own trees and epochs."""
    asked = []

    class Stop(Exception):
        pass

    def ask(*_, **how):
        asked.append(how)
        raise Stop

    for name in ("run_eta", "run_sequence_eta", "run_window_eta"):
        monkeypatch.setattr(catalog.pipelines, name, ask)
    for name in ("rf_eta_metrics", "rf_importance", "eta_point", "lstm_sequence_metrics", "lstm_window_metrics", "lstm_window_history"):
        with pytest.raises(Stop):
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(asked) == 6 and not any({"trees", "epochs", "size", "stride"} & set(how) for how in asked)
