"""Reading and cleaning position reports.

Canonical columns: mmsi bigint, row_ord bigint, ts timestamp_ntz, lat, lon, lon_360, sog double and, where
the input has one, heading double.  A missing number is null, never NaN.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions.geo import lon_360

#: First alias present wins.
ALIASES = {
    "mmsi": ("MMSI", "DeviceID"),
    "lat": ("Lat",),
    "lon": ("Long", "Lng"),
    "ts": ("Timestamp", "DataSourceLastTime_UTC", "CreateTime"),
    "sog": ("Sog",),
    "heading": ("Hdg", "Heading"),
}
REQUIRED = ("lat", "lon", "ts")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, with the ordinal of the row: the order of ties and of cluster ids."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("row_ord", F.monotonically_increasing_id())


def resolve_aliases(raw: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Canonical names; ValueError if no alias of a required column is there."""
    found = {name: next((a for a in aliases if a in raw.columns), None) for name, aliases in ALIASES.items()}
    missing = [name for name in required if found[name] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}; accepted: {', '.join('/'.join(ALIASES[m]) for m in missing)}")
    kept = ["row_ord"] if "row_ord" in raw.columns else []
    return raw.select(*kept, *(F.col(a).alias(name) for name, a in found.items() if a))


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def number(c: str, strict: bool = False, kind: str = "string") -> Column:
    """A double; junk and NaN become null, or with ``strict`` junk is an error.  Numbers are not parsed anew."""
    if strict or kind in _NUMBERS:
        v = F.col(c).cast("double")
    else:
        text = F.trim(F.col(c).cast("string"))
        v = F.when(~text.rlike("[dDfF]$") | text.rlike("(?i)inf$"), text.try_cast("double"))
    return F.when(~F.isnan(v), v)


def timestamp(c: str, compact_only: bool = False, kind: str = "string") -> Column:
    """ISO, else yyyyMMddHHmmss; null if neither.  Timestamps are not parsed anew."""
    if kind.startswith("timestamp"):
        return F.col(c).cast("timestamp_ntz")
    text = F.col(c).cast("string")
    compact = F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))
    auto = F.when(~text.rlike("^[0-9]+$"), F.try_to_timestamp(text))
    return (compact if compact_only else F.coalesce(auto, compact)).cast("timestamp_ntz")


def in_range(lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)


def clean(raw: DataFrame, mmsi: int | None = None, keep_missing_sog: bool = False, strict: bool = False, compact_ts: bool = False, sog_range: tuple[float, float] | None = None) -> DataFrame:
    """Canonical, cleaned positions of one vessel or of all."""
    df = resolve_aliases(raw)
    if "row_ord" not in df.columns:
        df = df.withColumn("row_ord", F.monotonically_increasing_id())
    df = df.withColumn("mmsi", F.col("mmsi").cast("string").try_cast("bigint") if "mmsi" in df.columns else F.lit(None).cast("bigint"))
    if mmsi is not None:
        df = df.where(F.col("mmsi") == mmsi)
    kinds = dict(df.dtypes)
    for c in ("lat", "lon", "sog", "heading"):
        if c in df.columns:
            df = df.withColumn(c, number(c, strict and c in ("lat", "lon"), kinds[c]))
        elif c == "sog":
            df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumn("ts", timestamp("ts", compact_ts, kinds["ts"])).where(in_range())
    df = df.dropna(subset=["lat", "lon", "ts"] if keep_missing_sog else ["lat", "lon", "ts", "sog"])
    if sog_range is not None:
        df = df.where(F.col("sog").between(*sog_range))
    out = ["mmsi", "row_ord", "ts", "lat", "lon", lon_360("lon").alias("lon_360"), "sog"]
    return df.select(*out, *(["heading"] if "heading" in df.columns else []))


def repair_sog(points: DataFrame, after: str = "2025-07-25 10:58:10", factor: float = 10.0) -> DataFrame:
    """Divides speeds reported later than ``after``, which came in tenths."""
    late = F.col("ts") > F.lit(after).cast("timestamp_ntz")
    return points.withColumn("sog", F.when(late, F.col("sog") / factor).otherwise(F.col("sog")))


def slow(points: DataFrame, sog_threshold: float = 0.2) -> DataFrame:
    return points.where(F.col("sog") < sog_threshold)


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """Ports CSV with name (or port_name), lat, lon, in file order (``port_ord``)."""
    df = spark.read.option("header", True).csv(path)
    if "name" in df.columns and "port_name" not in df.columns:
        df = df.withColumnRenamed("name", "port_name")
    missing = {"port_name", "lat", "lon"} - set(df.columns)
    if missing:
        raise ValueError(f"ports lack columns: {', '.join(sorted(missing))}")
    return df.select("port_name", number("lat").alias("lat"), number("lon").alias("lon"), F.monotonically_increasing_id().alias("port_ord"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw position reports shaped from the ``events`` table: two vessels that call at five ports in turn."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")
    )
    e = e.selectExpr("*", "s div 43200 as leg", "(s % 43200) / 43200D as ph")
    lat = "case {0} % 6 when 0 then 25.15D when 1 then 25.195D when 2 then 24.20D when 3 then 24.20D when 4 then 22.60D else 22.61D end"
    lon = "case {0} % 6 when 0 then 121.75D when 1 then 121.78D when 2 then 120.50D when 3 then 120.50D when 4 then 120.28D else 120.29D end"
    e = e.selectExpr("*", "ph < 0.35D as still", "case when ph < 0.35D then 0D else (ph - 0.35D) / 0.65D end as fr")
    e = e.where("not (leg % 6 = 3 and ph between 0.5D and 0.8D)")
    jitter = "case when not still then 0D when leg % 12 = 5 then (user_id % 7) * 0.002D else (user_id % 7) * 0.0001D end"
    return e.selectExpr(
        "416000000L + user_id % 2 as mmsi",
        "event_id as row_ord",
        "ts",
        f"{lat.format('leg')} + ({lat.format('(leg + 1)')} - {lat.format('leg')}) * fr + {jitter} as lat",
        f"{lon.format('leg')} + ({lon.format('(leg + 1)')} - {lon.format('leg')}) * fr as lon",
        "case when still and event_type = 'error' and user_id % 3 = 0 then 1.5D when still then (user_id % 4) * 0.1D else 8D + user_id % 10 end as sog",
        "case when user_id % 11 = 0 then 511D else cast((user_id * 37) % 360 as double) end as heading",
    ).withColumn("lon_360", lon_360("lon"))
