"""Density clustering on great-circle distance, and the ports found with it.

Positions are deduplicated first, with weights: copies share their neighbourhood.  Positions in one fine
cell, whose diagonal is ``eps``, are neighbours without a pair being formed; pairs are formed between
different fine cells only, by an equi-join on the coarse cells around a position.

``grid`` mode takes as candidates the 3 x 3 coarse cells in degrees and so misses neighbours across 180
degrees and, at high latitude, beyond the next cell; ``exact`` mode indexes unit vectors in cubes and does not.
Cluster ids are 0-based in order of each cluster's first core point by ``row_ord``; noise is -1.  A border
point goes to its ``last`` (highest) or ``first`` (lowest) adjacent cluster.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import EARTH_KM, haversine_km, haversine_rad
from wakeline.operators.graph import Scratch, components


def _cells(df: DataFrame, eps: float, mode: str) -> tuple[DataFrame, list[str], list[str]]:
    """Adds coarse and fine cell columns; returns the frame and both lists of names."""
    if mode == "grid":
        side = max(math.degrees(eps), 1e-6)
        axes = {"a": F.col("lat"), "o": F.col("lon")}
        fine = side / math.sqrt(2) * (1 - 1e-9)
    else:
        side = 2 * math.sin(min(eps, math.pi) / 2)
        lat, lon = F.radians("lat"), F.radians("lon")
        axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
        fine = side / math.sqrt(3) * (1 - 1e-9)
    for n, c in axes.items():
        df = df.withColumn(f"c{n}", F.floor(c / side)).withColumn(f"f{n}", F.floor(c / fine))
    return df, [f"c{n}" for n in axes], [f"f{n}" for n in axes]


def dbscan(points: DataFrame, eps: float, min_samples: int, key: list[str] = (), mode: str = "grid", border: str = "last") -> DataFrame:
    """``points(*key, row_ord, lat, lon)`` with ``cluster_id``; ``eps`` in radians, inclusive.

    ``points`` is read twice and joined to itself on positions, which must be the same to the last bit both
    times: averages over a shuffle are not, and have to be written first.
    """
    key = list(key)
    scratch = Scratch(points.sparkSession, "dbscan")
    spots = points.groupBy(*key, "lat", "lon").agg(F.count("*").alias("w"), F.min("row_ord").alias("pid"))
    spots, coarse, fine = _cells(spots, eps, mode)
    spots = spots.withColumn("tag", F.xxhash64(*key) if key else F.lit(0).cast("long")).withColumn("cell", F.struct(*fine))
    spots = scratch.cut(spots, "spots")
    dense = spots.groupBy("tag", "cell").agg(F.sum("w").alias("cell_w"))
    near = [F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])).alias(c) for c in coarse]
    left = spots.select("tag", "pid", "lat", "lon", "cell", *coarse)
    for column, name in zip(near, coarse, strict=True):
        left = left.select(*[c for c in left.columns if c != name], column)
    right = spots.select("tag", F.col("pid").alias("q"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.col("cell").alias("qcell"), F.col("w").alias("qw"), *coarse)
    pairs = left.join(right, ["tag", *coarse]).where("cell <> qcell").where(haversine_rad("lat", "lon", "qlat", "qlon") <= eps).select("tag", "pid", "q", "qw")
    pairs = scratch.cut(pairs, "pairs")
    beyond = pairs.groupBy("tag", "pid").agg(F.sum("qw").alias("other_w"))
    spots = spots.join(dense, ["tag", "cell"]).join(beyond, ["tag", "pid"], "left")
    spots = spots.withColumn("core", F.col("cell_w") + F.coalesce("other_w", F.lit(0)) >= min_samples)
    spots = scratch.cut(spots.drop("cell_w", "other_w"), "cores")
    # Row ordinals may repeat between keys: number the core spots through.
    cores = spots.where("core").select("tag", "pid", "cell", F.xxhash64("tag", "pid").alias("node"))
    hub = cores.groupBy("tag", "cell").agg(F.min("node").alias("hub"))
    inner = cores.join(hub, ["tag", "cell"]).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    a, b = cores.select("tag", "pid", F.col("node").alias("u")), cores.select("tag", F.col("pid").alias("q"), F.col("node").alias("v"))
    cross = pairs.where("pid < q").join(a, ["tag", "pid"]).join(b, ["tag", "q"]).select("u", "v")
    roots = components(scratch, inner.union(cross))
    named = cores.join(roots, cores.node == roots.node, "left").select("tag", "pid", "cell", F.coalesce(roots.root, cores.node).alias("root"))
    first = named.groupBy("tag", "root").agg(F.min("pid").alias("first"))
    first = first.withColumn("cluster_id", (F.row_number().over(Window.partitionBy("tag").orderBy("first")) - 1).cast("int"))
    core = scratch.cut(named.join(first.drop("first"), ["tag", "root"]).select("tag", "pid", "cell", "cluster_id"), "labels")
    pick = F.max if border == "last" else F.min
    rest = spots.where("not core").select("tag", "pid", "cell")
    by_pair = pairs.select("tag", "pid", "q").join(core.select("tag", F.col("pid").alias("q"), "cluster_id"), ["tag", "q"]).select("tag", "pid", "cluster_id")
    by_cell = rest.join(core.select("tag", "cell", "cluster_id"), ["tag", "cell"]).select("tag", "pid", "cluster_id")
    edge = rest.select("tag", "pid").join(by_pair.union(by_cell), ["tag", "pid"], "left").groupBy("tag", "pid").agg(F.coalesce(pick("cluster_id"), F.lit(-1)).alias("cluster_id"))
    label = core.select("tag", "pid", "cluster_id").union(edge)
    back = scratch.cut(spots.join(label, ["tag", "pid"]).select(*key, "lat", "lon", "cluster_id"), "spots")
    return points.join(back, [*key, "lat", "lon"])


def summarise(members: DataFrame, by: list[str], radius: str = "q95") -> DataFrame:
    """Centroid, radius and size; radius is 1.2 times the 95 % quantile of distances, or the maximum."""
    center = members.groupBy(*by).agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), F.count("*").alias("num_points"))
    d = haversine_km("lat", "lon", "center_lat", "center_lon")
    size = F.percentile(d, F.lit(0.95)) * 1.2 if radius == "q95" else F.max(d)
    out = members.join(center.select(*by, "center_lat", "center_lon"), by).groupBy(*by).agg(size.alias("radius_km"))
    return center.join(out, by).select(*by, "center_lat", "center_lon", "radius_km", "num_points")


def first_stage(slow: DataFrame, eps: float = 0.01, min_samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """Clusters of slow points: (members, summary)."""
    members = Scratch(slow.sparkSession, "stage").cut(dbscan(slow, eps, min_samples).where("cluster_id >= 0"), "members")
    return members, summarise(members, ["cluster_id"])


def merge(members: DataFrame, summary: DataFrame, eps_km: float = 1.0) -> DataFrame:
    """Ports: clusters whose centres chain within ``eps_km``, measured anew over their points."""
    centers = summary.select(F.col("cluster_id").cast("long").alias("row_ord"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    centers = Scratch(members.sparkSession, "merge").cut(centers, "centers")
    port = dbscan(centers, eps_km / EARTH_KM, 1).select(F.col("row_ord").cast("int").alias("cluster_id"), F.col("cluster_id").alias("port_id"))
    return summarise(members.join(port, "cluster_id"), ["port_id"])


def detect_ports(points: DataFrame, sog_threshold: float = 0.2, eps: float = 0.01, min_samples: int = 10, merge_km: float = 1.0) -> DataFrame:
    """port_id, center_lat, center_lon, radius_km, num_points."""
    return merge(*first_stage(points.where(F.col("sog") < sog_threshold), eps, min_samples), merge_km)


def one_stage_ports(points: DataFrame, key: list[str], sog: float = 0.5, eps: float = 0.01, min_samples: int = 10, lon: str = "lon") -> DataFrame:
    """Ports of each vessel with the largest distance as radius."""
    slow = points.where(F.col("sog") < sog).select(*key, "row_ord", "lat", F.col(lon).alias("lon"))
    members = dbscan(slow, eps, min_samples, key, "exact", "first").where("cluster_id >= 0")
    return summarise(members, [*key, "cluster_id"], "max")


def stop_centers(labelled: DataFrame, eps_km: float = 1.0, min_samples: int = 3) -> DataFrame:
    """(mmsi, cluster_id, lat, lon): medians of the clusters of all rows that belong to no voyage."""
    free = labelled.where("voyage_id is null").select("mmsi", F.col("idx").alias("row_ord"), "lat", "lon")
    got = dbscan(free, eps_km / EARTH_KM, min_samples, ["mmsi"], "exact", "first").where("cluster_id >= 0")
    return got.groupBy("mmsi", "cluster_id").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))
