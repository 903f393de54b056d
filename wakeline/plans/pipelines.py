"""The three end-to-end plans: voyages with ports, port detection, arrival-time regression."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import clusters, models, recurrent, sequences, stops, voyages
from wakeline.operators.graph import Scratch

COLUMNS = [
    "mmsi", "voyage_id", "start_idx", "end_idx", "dep_time", "arr_time", "duration_hr", "displacement_km", "path_len_km", "heading_cum_deg", "n_points",
    "valid_flag", "invalid_reason", "dep_lat", "dep_lon", "arr_lat", "arr_lon", "origin_port", "destination_port",
]


@dataclass
class Track:
    """Labelled points and stops of a track, written once since every later step reads them."""

    points: DataFrame
    segments: DataFrame


def track(points: DataFrame, variant: str = "a", **rules) -> Track:
    """Stops by speed alone and by extent (``a``), or by speed, stillness and duration (``b``)."""
    scratch = Scratch(points.sparkSession, "track")
    rule = stops.slow_only if variant == "a" else stops.slow_and_still
    marked = scratch.cut(stops.sessions(rule(stops.ordered(points))), "marked")
    limits = {"max_r95_km": 0.3 if variant == "a" else None} | rules
    segments = scratch.cut(stops.segments(marked, **limits), "segments")
    return Track(scratch.cut(voyages.label(marked, segments), "labelled"), segments)


def run_voyages(points: DataFrame, ports: DataFrame | None = None, **rules) -> DataFrame:
    """Voyages with measures, quality and, given ports, where they began and ended."""
    t = track(points)
    out = voyages.quality(voyages.summarise(t.points), clusters.stop_centers(t.points), **rules)
    return out.select(COLUMNS[:-2]) if ports is None else voyages.assign_ports(out, ports).select(COLUMNS)


def detect_ports(points: DataFrame, **rules) -> DataFrame:
    return clusters.detect_ports(points, **rules)


def eta_rows(points: DataFrame, variant: str = "b") -> DataFrame:
    t = track(points, variant)
    return voyages.eta_features(t.points, t.segments)


@dataclass
class Eta:
    model: object
    predicted: DataFrame
    metrics: DataFrame
    importances: DataFrame


def run_eta(points: DataFrame, trees: int = 100, depth: int = 10) -> Eta:
    rows = Scratch(points.sparkSession, "eta").cut(models.assemble(eta_rows(points)).drop("features"), "rows")
    train, test = models.split(models.assemble(rows))
    model = models.fit(train, trees, depth)
    predicted = model.transform(test)
    return Eta(model, predicted, models.metrics(predicted), models.importances(points.sparkSession, model))


def training_sequences(points: DataFrame, longest: int = 500, fewest: int = 10) -> DataFrame:
    """Chunks are cut first; rows that lack a feature or the target go before a chunk is standardised."""
    cut = sequences.chunks(eta_rows(points), longest, fewest).dropna(subset=["real_eta_sec", *sequences.FEATURES])
    return sequences.padded(sequences.standardised(cut))


@dataclass
class RecurrentEta:
    model: recurrent.Recurrent | None
    predicted: DataFrame
    metrics: DataFrame
    history: DataFrame


def _recurrent(spark, rows: DataFrame, model: recurrent.Recurrent | None, each: str) -> RecurrentEta:
    kind = "array<double>" if each == "step" else "double"
    predicted = recurrent.predict(rows, model) if model else rows.withColumn("prediction", F.lit(None).cast(kind))
    flat = recurrent.steps_of(predicted) if each == "step" else predicted
    return RecurrentEta(model, predicted, models.metrics(flat, "y"), recurrent.history(spark, model))


def run_sequence_eta(points: DataFrame, **how) -> RecurrentEta:
    """One arrival time per step of whole voyages, standardised, cut and padded."""
    spark = points.sparkSession
    rows = Scratch(spark, "sequences").cut(training_sequences(points), "padded")
    return _recurrent(spark, rows, recurrent.fit_sequences(rows, **how), "step")


def run_window_eta(points: DataFrame, size: int = 50, stride: int = 25, **how) -> RecurrentEta:
    """The arrival time at the end of each sliding window of whole voyages in motion, features as they are."""
    spark = points.sparkSession
    rows = Scratch(spark, "windows").cut(sequences.windows(eta_rows(points), size, stride), "windows")
    return _recurrent(spark, rows, recurrent.fit_windows(rows, **how), "window")


def counts(t: Track) -> DataFrame:
    """Points, stops and voyages of each vessel."""
    p = t.points.groupBy("mmsi").agg(F.count("*").alias("points"), F.count_distinct("voyage_id").alias("voyages"))
    return p.join(t.segments.groupBy("mmsi").agg(F.count("*").alias("stops"), F.count_if("kept").alias("kept_stops")), "mmsi", "left")


def valid_voyages(judged: DataFrame) -> DataFrame:
    """Voyages of each vessel, and how many of them are valid."""
    return judged.groupBy("mmsi").agg(F.count("*").alias("voyages"), F.count_if("valid_flag").alias("valid_voyages"))
