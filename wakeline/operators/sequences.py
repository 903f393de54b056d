"""Fixed-length training sequences from labelled voyages."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.voyages import KEY

FEATURES = ("lat", "lon_360", "sog", "heading", "dist_to_dest_km")
WINDOW_FEATURES = ("lat", "lon_360", "sog", "heading")


def chunks(labelled: DataFrame, longest: int = 500, fewest: int = 10) -> DataFrame:
    """Adds ``segment_id``, from 1 in order of vessel and voyage: voyages of ``fewest`` points or more, cut at ``longest``."""
    w = Window.partitionBy(*KEY)
    df = labelled.where("voyage_id is not null").withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= fewest)
    df = df.withColumn("chunk", F.floor((F.row_number().over(w.orderBy("idx")) - 1) / longest))
    # Segments are numbered within vessels, and on from the vessels before: one ordered task sees vessels only.
    own = df.select(*KEY, "chunk").distinct().withColumn("_own", F.row_number().over(Window.partitionBy("mmsi").orderBy("voyage_id", "chunk")))
    before = Window.orderBy("mmsi").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("mmsi").agg(F.count("*").alias("_m")).select("mmsi", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    order = own.join(base, "mmsi").select(*KEY, "chunk", (F.col("_base") + F.col("_own")).cast("long").alias("segment_id"))
    return df.drop("_n").join(order, [*KEY, "chunk"])


def standardised(segments: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Each column to mean 0 and population deviation 1 within its segment; a constant column to 0."""
    w = Window.partitionBy("segment_id")
    out = {f"{c}_std": (F.col(c) - F.avg(c).over(w)) / F.coalesce(F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return segments.withColumns(out)


def padded(segments: DataFrame, columns: tuple[str, ...] = tuple(f"{c}_std" for c in FEATURES), target: str = "real_eta_sec", shortest: int = 3) -> DataFrame:
    """Per segment arrays of the longest segment's length, zeros first: ``x`` of feature rows and ``y`` of targets."""
    row = F.struct("idx", F.array(*[F.col(c).cast("float") for c in columns]).alias("x"), F.col(target).cast("float").alias("y"))
    seq = segments.groupBy("segment_id").agg(F.array_sort(F.collect_list(row)).alias("s")).where(F.size("s") >= shortest)
    longest = seq.agg(F.max(F.size("s")).alias("longest"))
    seq = seq.join(F.broadcast(longest))
    zero = F.array(*[F.lit(0.0).cast("float")] * len(columns))
    pad = F.col("longest") - F.size("s")
    return seq.select(
        "segment_id", F.size("s").alias("length"), F.concat(F.array_repeat(zero, pad), F.col("s.x")).alias("x"), F.concat(F.array_repeat(F.lit(0.0).cast("float"), pad), F.col("s.y")).alias("y")
    )


def windows(features: DataFrame, size: int = 50, stride: int = 25, columns: tuple[str, ...] = WINDOW_FEATURES) -> DataFrame:
    """Full windows of rows in motion: ``x`` of feature rows, ``y`` the last row's time to arrival."""
    moving = features.where("not is_stop").dropna(subset=[*columns, "real_eta_sec"])
    by = Window.partitionBy(*KEY)
    df = moving.withColumn("rn", F.row_number().over(by.orderBy("idx")) - 1).withColumn("n", F.count("*").over(by))
    # A row is in the windows that begin at multiples of the stride in (rn - size, rn].
    lo = F.greatest(F.lit(0), F.ceil((F.col("rn") - (size - 1)) / stride))
    hi = F.least(F.floor(F.col("rn") / stride), F.floor((F.col("n") - size) / stride))
    df = df.where(F.col("n") >= size).where(lo <= hi).withColumn("window_id", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    row = F.struct("rn", F.array(*[F.col(c).cast("float") for c in columns]).alias("x"))
    return df.groupBy(*KEY, "window_id").agg(F.array_sort(F.collect_list(row)).alias("s"), F.max_by("real_eta_sec", "rn").alias("y")).select(*KEY, "window_id", F.col("s.x").alias("x"), "y")
