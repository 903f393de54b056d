"""CSV and map files.  Maps are small: ports are collected, and lines are thinned to a bounded number of points."""

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8">
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css"><script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>#map{{height:100vh}}body{{margin:0}}</style></head><body><div id="map"></div><script>
const map = L.map("map").setView({center}, {zoom});
L.tileLayer("https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png").addTo(map);
for (const s of {shapes}) {{
  const g = s.kind === "line" ? L.polyline(s.at, s.style) : s.kind === "circle" ? L.circle(s.at, s.style) : L.marker(s.at, {{title: s.popup, icon: L.divIcon({{className: "", html: "<span style='font-size:22px;color:" + s.color + "'>" + ({{play: "\u25b6", stop: "\u25a0", anchor: "\u2693"}})[s.icon] + "</span>"}})}});
  g.addTo(map); if (s.popup) g.bindPopup(s.popup);
}}
</script></body></html>
"""


def _write(path: str, center: tuple[float, float], zoom: int, shapes: list[dict]) -> str:
    data = json.dumps(shapes).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(center=json.dumps(list(center)), zoom=zoom, shapes=data))
    return path


def _marker(at: list[float], icon: str, color: str, popup: str) -> dict:
    return {"kind": "marker", "at": at, "icon": icon, "color": color, "popup": popup}


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv_bom(df: DataFrame, path: str) -> int:
    """One UTF-8 file with a byte-order mark, row by row; the number of rows."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_ports_csv(ports: DataFrame, path: str) -> bool:
    """Writes only if there is a port."""
    if ports.isEmpty():
        return False
    write_csv(ports, path)
    return True


def voyage_map(labelled: DataFrame, voyages: DataFrame, path: str, most: int = 500) -> str | None:
    """One line per voyage, blue if valid and red if not, with its start and end; None if there is nothing to draw.

    Of a voyage, about ``most`` points at an even stride are drawn, the first and the last among them.
    """
    by = Window.partitionBy("mmsi", "voyage_id")
    at, n = F.row_number().over(by.orderBy("idx")) - 1, F.count("*").over(by)
    drawn = labelled.where("voyage_id is not null").withColumn("_at", at).withColumn("_n", n)
    drawn = drawn.where((F.pmod("_at", F.greatest(F.expr(f"cast(ceil(_n / {most}) as int)"), F.lit(1))) == 0) | (F.col("_at") == F.col("_n") - 1))
    rows = drawn.groupBy("mmsi", "voyage_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon_360"))).alias("t"))
    rows = rows.join(voyages.select("mmsi", "voyage_id", "valid_flag", "invalid_reason"), ["mmsi", "voyage_id"]).orderBy("mmsi", "voyage_id").collect()
    mid = labelled.agg(F.avg("lat"), F.avg("lon_360")).first()
    if not rows or mid[0] is None:
        return None
    shapes = []
    for r in rows:
        line = [[p["lat"], p["lon_360"]] for p in r["t"]]
        popup = f"Voyage {r['voyage_id']} | Valid={r['valid_flag']} | Reason={html.escape(str(r['invalid_reason']))}"
        shapes.append({"kind": "line", "at": line, "style": {"color": "blue" if r["valid_flag"] else "red", "weight": 3, "opacity": 0.7}, "popup": popup})
        shapes += [_marker(line[0], "play", "green", f"Start {r['voyage_id']}"), _marker(line[-1], "stop", "orange", f"End {r['voyage_id']}")]
    return _write(path, (mid[0], mid[1]), 6, shapes)


def port_map(ports: DataFrame, path: str, zoom: int = 6) -> str | None:
    """A circle and a marker for each port; None without ports."""
    rows = ports.orderBy("port_id").collect()
    if not rows:
        return None
    shapes = []
    for r in rows:
        at, popup = [r["center_lat"], r["center_lon"]], f"Port {r['port_id']}<br>Radius: {r['radius_km']:.2f} km<br>Points: {r['num_points']}"
        shapes.append({"kind": "circle", "at": at, "style": {"radius": r["radius_km"] * 1000, "color": "blue", "fill": True, "fillOpacity": 0.2}, "popup": popup})
        shapes.append(_marker(at, "anchor", "red", f"Port {r['port_id']}"))
    center = (sum(r["center_lat"] for r in rows) / len(rows), sum(r["center_lon"] for r in rows) / len(rows))
    return _write(path, center, zoom, shapes)


def track_map(points: DataFrame, path: str, stride: int = 1) -> str | None:
    """One vessel's track, every ``stride``-th row, with its first and last time."""
    n = F.row_number().over(Window.partitionBy("mmsi").orderBy("ts", "row_ord")) - 1
    rows = points.withColumn("_n", n).where(F.pmod("_n", F.lit(stride)) == 0).orderBy("ts", "row_ord").select("lat", "lon_360", "ts").collect()
    if not rows:
        return None
    line = [[r["lat"], r["lon_360"]] for r in rows]
    mid = (sum(p[0] for p in line) / len(line), sum(p[1] for p in line) / len(line))
    shapes = [{"kind": "line", "at": line, "style": {"weight": 2}, "popup": ""}, _marker(line[0], "play", "green", f"Start {rows[0]['ts']}"), _marker(line[-1], "stop", "red", f"End {rows[-1]['ts']}")]
    return _write(path, mid, 4, shapes)
