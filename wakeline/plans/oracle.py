"""DuckDB SQL for the registered queries, built from common table expressions on ``events``."""

R = "6371.0088::DOUBLE"


def hav(a: str, b: str, c: str, d: str, r: str = R) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(2 * {r} * asin(sqrt(CASE WHEN {h} > 1 THEN 1.0::DOUBLE ELSE {h} END)))"


def _port(axis: int, leg: str) -> str:
    at = [(25.15, 121.75), (25.195, 121.78), (24.20, 120.50), (24.20, 120.50), (22.60, 120.28), (22.61, 120.29)]
    return f"CASE {leg} % 6 " + " ".join(f"WHEN {i} THEN {p[axis]}::DOUBLE" for i, p in enumerate(at)) + " END"


AIS = f"""
WITH RECURSIVE ev AS (SELECT event_id, ts, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
lg AS (SELECT *, s // 43200 AS leg, (s % 43200) / 43200.0::DOUBLE AS ph FROM ev),
fr AS (SELECT *, ph < 0.35::DOUBLE AS still, CASE WHEN ph < 0.35::DOUBLE THEN 0::DOUBLE ELSE (ph - 0.35::DOUBLE) / 0.65::DOUBLE END AS fr FROM lg
  WHERE NOT (leg % 6 = 3 AND ph BETWEEN 0.5::DOUBLE AND 0.8::DOUBLE)),
ais0 AS (SELECT 416000000 + user_id % 2 AS mmsi, event_id AS row_ord, ts,
  {_port(0, 'leg')} + ({_port(0, '(leg + 1)')} - {_port(0, 'leg')}) * fr + CASE WHEN NOT still THEN 0::DOUBLE WHEN leg % 12 = 5 THEN (user_id % 7) * 0.002::DOUBLE ELSE (user_id % 7) * 0.0001::DOUBLE END AS lat,
  {_port(1, 'leg')} + ({_port(1, '(leg + 1)')} - {_port(1, 'leg')}) * fr AS lon,
  CASE WHEN still AND event_type = 'error' AND user_id % 3 = 0 THEN 1.5::DOUBLE WHEN still THEN (user_id % 4) * 0.1::DOUBLE ELSE 8::DOUBLE + user_id % 10 END AS sog,
  CASE WHEN user_id % 11 = 0 THEN 511::DOUBLE ELSE CAST((user_id * 37) % 360 AS DOUBLE) END AS heading FROM fr),
ais AS (SELECT *, ((lon % 360) + 360) % 360 AS lon_360 FROM ais0)
"""

TRACK = AIS + """,
seq AS (SELECT *, row_number() OVER w - 1 AS idx, epoch_us(ts) / 1e6 AS e FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY ts, row_ord)),
raw AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS time_diff, abs(lat - lag(lat) OVER w) AS lat_diff, abs(lon_360 - lag(lon_360) OVER w) AS lon_diff FROM seq WINDOW w AS (PARTITION BY mmsi ORDER BY idx)),
delta AS (SELECT *, CASE WHEN time_diff > 1 THEN lat_diff / time_diff ELSE lat_diff END AS lat_rate, CASE WHEN time_diff > 1 THEN lon_diff / time_diff ELSE lon_diff END AS lon_rate FROM raw)
"""


def marked(variant: str) -> str:
    rule = "sog < 0.5" if variant == "a" else "sog < 0.5 AND lat_rate < 1e-4 AND lon_rate < 1e-4"
    return TRACK + f""",
st AS (SELECT *, coalesce({rule}, false) AS is_stop FROM delta),
pre AS (SELECT *, max(CASE WHEN is_stop THEN ts END) OVER (PARTITION BY mmsi ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst,
  lag(is_stop) OVER w AS ps, lag(ts) OVER w AS pt FROM st WINDOW w AS (PARTITION BY mmsi ORDER BY idx)),
opened AS (SELECT *, is_stop AND (lst IS NULL OR coalesce(NOT ps AND (epoch_us(pt) - epoch_us(lst)) / 1e6 > 120, false)) AS o FROM pre),
seg AS (SELECT *, CASE WHEN is_stop THEN sum(o::INT) OVER (PARTITION BY mmsi ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS seg FROM opened),
fill AS (SELECT *, max(seg) OVER (PARTITION BY mmsi ORDER BY idx ROWS UNBOUNDED PRECEDING) AS bwd, min(seg) OVER (PARTITION BY mmsi ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fwd FROM seg),
marked AS (SELECT *, CASE WHEN bwd = fwd THEN bwd END AS stop_id FROM fill)
"""


def labelled(variant: str) -> str:
    extent = " AND r95_km <= 0.3" if variant == "a" else ""
    return marked(variant) + f""",
size AS (SELECT mmsi, stop_id, min(idx) AS first_idx, max(idx) AS last_idx, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_points, median(lat) AS center_lat, median(lon) AS center_lon,
  avg(lat) AS mean_lat, avg(lon_360) AS mean_lon_360 FROM marked WHERE stop_id IS NOT NULL GROUP BY mmsi, stop_id),
radius AS (SELECT m.mmsi, m.stop_id, quantile_cont({hav('lat', 'lon', 'center_lat', 'center_lon')}, 0.95) AS r95_km FROM marked m JOIN size s ON m.mmsi = s.mmsi AND m.stop_id = s.stop_id GROUP BY m.mmsi, m.stop_id),
long AS (SELECT s.*, r95_km, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS duration_s FROM size s JOIN radius USING (mmsi, stop_id)),
segments AS (SELECT *, duration_s >= 1800{extent} AS kept FROM long),
kept AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY stop_id) AS rank FROM segments WHERE kept),
joined AS (SELECT m.*, k.rank, k.start_ts FROM marked m LEFT JOIN kept k ON m.mmsi = k.mmsi AND m.stop_id = k.stop_id),
around AS (SELECT *, max(rank) OVER (PARTITION BY mmsi ORDER BY idx ROWS UNBOUNDED PRECEDING) AS prev_rank, min(start_ts) OVER (PARTITION BY mmsi ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_start FROM joined),
labelled AS (SELECT *, CASE WHEN rank IS NULL AND prev_rank IS NOT NULL AND next_start IS NOT NULL THEN prev_rank END AS voyage_id,
  CASE WHEN rank IS NULL AND prev_rank IS NOT NULL AND next_start IS NOT NULL THEN (epoch_us(next_start) - epoch_us(ts)) / 1e6 END AS real_eta_sec FROM around)
"""


def summary(variant: str) -> str:
    turn = "heading - lag(heading) OVER v"
    return labelled(variant) + f""",
step AS (SELECT *, {hav('lag(lat) OVER v', 'lag(lon) OVER v', 'lat', 'lon')} AS km, (epoch_us(ts) - epoch_us(lag(ts) OVER v)) / 1e6 AS gap FROM labelled WHERE voyage_id IS NOT NULL WINDOW v AS (PARTITION BY mmsi, voyage_id ORDER BY idx)),
turns AS (SELECT mmsi, voyage_id, {turn} AS t FROM labelled WHERE voyage_id IS NOT NULL AND heading IS NOT NULL AND heading <> 511 WINDOW v AS (PARTITION BY mmsi, voyage_id ORDER BY idx)),
wrapped AS (SELECT mmsi, voyage_id, sum(abs(CASE WHEN t > 180 THEN t - 360 WHEN t < -180 THEN t + 360 ELSE t END)) AS deg FROM turns GROUP BY mmsi, voyage_id),
agg AS (SELECT mmsi, voyage_id, min(idx) AS start_idx, max(idx) AS end_idx, min(ts) AS dep_time, max(ts) AS arr_time, arg_min(lat, idx) AS dep_lat, arg_min(lon, idx) AS dep_lon, arg_max(lat, idx) AS arr_lat, arg_max(lon, idx) AS arr_lon,
  coalesce(sum(km), 0) AS path_len_km, count(*) AS n_points, max(gap) AS max_gap_s, min(gap) AS min_gap, avg(gap) AS mean_gap FROM step GROUP BY mmsi, voyage_id),
summary AS (SELECT a.*, (epoch_us(arr_time) - epoch_us(dep_time)) / 1e6 / 3600 AS duration_hr, {hav('dep_lat', 'dep_lon', 'arr_lat', 'arr_lon')} AS displacement_km, coalesce(deg, 0) AS heading_cum_deg FROM agg a LEFT JOIN wrapped USING (mmsi, voyage_id))
"""


def dbscan(source: str, key: str, eps: str, min_samples: int, border: str, side: str | None, name: str) -> str:
    """``source(key, row_ord, lat, lon)`` to table ``name`` with cluster_id; ``side`` in degrees limits to adjacent cells."""
    n = name
    cells = f" AND abs(floor(a.lat / {side}) - floor(b.lat / {side})) <= 1 AND abs(floor(a.lon / {side}) - floor(b.lon / {side})) <= 1" if side else ""
    pick = "max" if border == "last" else "min"
    return f""",
{n}_spot AS (SELECT {key} AS k, lat, lon, count(*) AS w, min(row_ord) AS pid FROM {source} GROUP BY ALL),
{n}_pair AS (SELECT a.k, a.pid, b.pid AS q, b.w FROM {n}_spot a JOIN {n}_spot b ON a.k = b.k WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon', '1::DOUBLE')} <= {eps}{cells}),
{n}_core AS (SELECT k, pid FROM {n}_pair GROUP BY k, pid HAVING sum(w) >= {min_samples}),
{n}_link AS (SELECT p.k, p.pid, p.q FROM {n}_pair p JOIN {n}_core a ON p.k = a.k AND p.pid = a.pid JOIN {n}_core b ON p.k = b.k AND p.q = b.pid),
{n}_reach AS (SELECT k, pid AS a, pid AS b FROM {n}_core UNION SELECT r.k, r.a, l.q FROM {n}_reach r JOIN {n}_link l ON r.k = l.k AND r.b = l.pid),
{n}_root AS (SELECT k, a AS pid, min(b) AS root FROM {n}_reach GROUP BY k, a),
{n}_id AS (SELECT k, pid, dense_rank() OVER (PARTITION BY k ORDER BY root) - 1 AS cluster_id FROM {n}_root),
{n}_edge AS (SELECT p.k, p.pid, {pick}(i.cluster_id) AS cluster_id FROM {n}_pair p JOIN {n}_id i ON p.k = i.k AND p.q = i.pid WHERE NOT EXISTS (SELECT 1 FROM {n}_core c WHERE c.k = p.k AND c.pid = p.pid) GROUP BY p.k, p.pid),
{n}_label AS (SELECT * FROM {n}_id UNION ALL SELECT * FROM {n}_edge),
{n} AS (SELECT s.k, s.lat, s.lon, l.cluster_id, p.row_ord FROM {n}_spot s JOIN {n}_label l USING (k, pid) JOIN {source} p ON p.lat = s.lat AND p.lon = s.lon AND {key if key == '0' else 'p.' + key} = s.k)
"""


def centers() -> str:
    return summary("a") + ", free AS (SELECT mmsi, idx AS row_ord, lat, lon FROM labelled WHERE voyage_id IS NULL)" + dbscan(
        "free", "mmsi", f"1.0::DOUBLE / {R}", 3, "first", None, "db"
    ) + ", centers AS (SELECT k AS mmsi, cluster_id, median(lat) AS lat, median(lon) AS lon FROM db GROUP BY k, cluster_id)\n"


def quality() -> str:
    near = "(SELECT mmsi, voyage_id, arg_min(cluster_id, (d, cluster_id)) AS c, min(d) AS d FROM (SELECT s.mmsi, s.voyage_id, c.cluster_id, {} AS d FROM summary s JOIN centers c ON s.mmsi = c.mmsi) GROUP BY mmsi, voyage_id)"
    return centers() + f""",
dep AS {near.format(hav('s.dep_lat', 's.dep_lon', 'c.lat', 'c.lon'))},
arr AS {near.format(hav('s.arr_lat', 's.arr_lon', 'c.lat', 'c.lon'))},
judged AS (SELECT s.*, CASE WHEN dep.c = arr.c THEN 'R0_same_cluster' WHEN dep.d < 1 AND arr.d < 1 AND displacement_km < 1 THEN 'R1_nearby_clusters'
  WHEN duration_hr * 3600 < 1800 OR displacement_km < 2 THEN 'R2_too_short' WHEN heading_cum_deg > 0 AND displacement_km < 2 AND heading_cum_deg >= 360 THEN 'R4a_spin_in_place'
  WHEN heading_cum_deg > 0 AND path_len_km > 0 AND heading_cum_deg / path_len_km > 150 THEN 'R4b_excessive_turns' WHEN max_gap_s > 7200 THEN 'R5_large_time_gap' END AS invalid_reason
  FROM summary s LEFT JOIN dep USING (mmsi, voyage_id) LEFT JOIN arr USING (mmsi, voyage_id))
"""


def ported(ports: list[tuple[str, float, float]]) -> str:
    rows = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {i})" for i, (n, a, b) in enumerate(ports))
    near = "(SELECT arg_min({{'n': p.n, 'd': {0}}}, ({0}, p.i)) FROM ports p)"
    return quality() + f""",
ports(n, lat, lon, i) AS (VALUES {rows}),
ends AS (SELECT j.*, {near.format(hav('j.dep_lat', 'j.dep_lon', 'p.lat', 'p.lon'))} AS o, {near.format(hav('j.arr_lat', 'j.arr_lon', 'p.lat', 'p.lon'))} AS t FROM judged j),
called AS (SELECT *, CASE WHEN o.d <= 10 THEN o.n ELSE 'unknown' END AS origin_port, CASE WHEN t.d <= 10 THEN t.n ELSE 'unknown' END AS destination_port FROM ends),
ported AS (SELECT *, coalesce(invalid_reason, CASE WHEN origin_port = 'unknown' OR destination_port = 'unknown' THEN 'R7_unknown_port' END) AS reason FROM called)
"""


def features() -> str:
    return labelled("a") + f""",
dest AS (SELECT mmsi, rank - 1 AS voyage_id, mean_lat AS dest_lat, CASE WHEN mean_lon_360 > 180 THEN mean_lon_360 - 360 ELSE mean_lon_360 END AS dest_lon FROM kept),
far AS (SELECT l.*, {hav('l.lat', 'CASE WHEN l.lon_360 > 180 THEN l.lon_360 - 360 ELSE l.lon_360 END', 'dest_lat', 'dest_lon')} AS dist_to_dest_km FROM labelled l LEFT JOIN dest d ON l.mmsi = d.mmsi AND l.voyage_id = d.voyage_id WHERE l.voyage_id IS NOT NULL),
features AS (SELECT *, CASE WHEN dist_to_dest_km < 1 THEN 1.0::DOUBLE WHEN dist_to_dest_km <= 5 THEN 0.5::DOUBLE WHEN dist_to_dest_km > 5 THEN 0.0::DOUBLE END AS near_port_flag FROM far)
"""


def chunked(longest: int) -> str:
    return features() + f""",
long_enough AS (SELECT *, (row_number() OVER (PARTITION BY mmsi, voyage_id ORDER BY idx) - 1) // {longest} AS chunk FROM features QUALIFY count(*) OVER (PARTITION BY mmsi, voyage_id) >= 10),
chunked AS (SELECT *, dense_rank() OVER (ORDER BY mmsi, voyage_id, chunk) AS segment_id FROM long_enough)
"""


def windows(size: int, stride: int) -> str:
    return features() + f""",
moving AS (SELECT *, row_number() OVER (PARTITION BY mmsi, voyage_id ORDER BY idx) - 1 AS rn, count(*) OVER (PARTITION BY mmsi, voyage_id) AS n FROM features WHERE NOT is_stop),
starts AS (SELECT DISTINCT mmsi, voyage_id, unnest(generate_series(0, (n - {size}) // {stride})) AS window_id FROM moving WHERE n >= {size}),
windowed AS (SELECT s.mmsi, s.voyage_id, s.window_id, l.real_eta_sec AS y, f.lat AS first_lat FROM starts s
  JOIN moving l ON l.mmsi = s.mmsi AND l.voyage_id = s.voyage_id AND l.rn = s.window_id * {stride} + {size - 1}
  JOIN moving f ON f.mmsi = s.mmsi AND f.voyage_id = s.voyage_id AND f.rn = s.window_id * {stride})
"""


def _measured(members: str, by: str, radius: str, out: str) -> str:
    d = hav("m.lat", "m.lon", "c.center_lat", "c.center_lon")
    size = f"quantile_cont({d}, 0.95) * 1.2" if radius == "q95" else f"max({d})"
    return f""",
{out}_c AS (SELECT {by}, avg(lat) AS center_lat, avg(lon) AS center_lon, count(*) AS num_points FROM {members} GROUP BY {by}),
{out} AS (SELECT {', '.join('c.' + x for x in by.split(', '))}, any_value(center_lat) AS center_lat, any_value(center_lon) AS center_lon, {size} AS radius_km, any_value(num_points) AS num_points
  FROM {members} m JOIN {out}_c c ON {' AND '.join(f'm.{x} = c.{x}' for x in by.split(', '))} GROUP BY {', '.join('c.' + x for x in by.split(', '))})
"""


def ports_stage1() -> str:
    return AIS + ", slow AS (SELECT row_ord, lat, lon FROM ais WHERE sog < 0.2)" + dbscan("slow", "0", "0.01::DOUBLE", 10, "last", "degrees(0.01::DOUBLE)", "db") + _measured("db", "cluster_id", "q95", "stage1")


def ports_merged() -> str:
    merged = ", mid AS (SELECT cluster_id AS row_ord, center_lat AS lat, center_lon AS lon FROM stage1)"
    return ports_stage1() + merged + dbscan("mid", "0", f"1.0::DOUBLE / {R}", 1, "last", f"degrees(1.0::DOUBLE / {R})", "mg") + (
        ", member AS (SELECT d.lat, d.lon, m.cluster_id AS port_id FROM db d JOIN mg m ON d.cluster_id = m.row_ord)" + _measured("member", "port_id", "q95", "ports")
    )


def ports_maxradius(eps: str = "0.0005", lon: str = "lon") -> str:
    return AIS + f", slow AS (SELECT mmsi, row_ord, lat, {lon} AS lon FROM ais WHERE sog < 0.5)" + dbscan("slow", "mmsi", f"{eps}::DOUBLE", 10, "first", None, "db") + (
        ", member AS (SELECT k AS mmsi, lat, lon, cluster_id FROM db)" + _measured("member", "mmsi, cluster_id", "max", "ports")
    )
