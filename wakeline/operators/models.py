"""Arrival-time regression on Spark ML."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.geo import eta_clock, haversine_atan2_km

FEATURES = ["lat", "lon_360", "sog", "dist_to_dest_km", "near_port_flag"]


def assemble(rows: DataFrame) -> DataFrame:
    clean = rows.dropna(subset=[*FEATURES, "real_eta_sec"]) if "real_eta_sec" in rows.columns else rows
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(clean)


def split(rows: DataFrame, one_in: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, about 80 to 20, by a hash of vessel and position in the track: reruns agree."""
    test = F.pmod(F.xxhash64("mmsi", "idx"), F.lit(one_in)) == 0
    return rows.where(~test), rows.where(test)


def fit(train: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestRegressionModel:
    forest = RandomForestRegressor(
        featuresCol="features", labelCol="real_eta_sec", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", maxBins=256
    )
    return forest.fit(train)


def metrics(predicted: DataFrame, label: str = "real_eta_sec") -> DataFrame:
    """mae, mse, rmse, r2 and the number of missing predictions, in one aggregate."""
    e = F.col(label) - F.col("prediction")
    mean = F.var_pop(F.when(F.col("prediction").isNotNull(), F.col(label)))
    out = predicted.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), mean.alias("v"), F.count_if(F.col("prediction").isNull()).alias("missing"))
    return out.select("mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "v")).alias("r2"), "missing")


def importances(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    rows = [(f, float(w)) for f, w in zip(FEATURES, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def eta_point(spark: SparkSession, model: RandomForestRegressionModel, lat: float, lon: float, sog: float, port_lat: float, port_lon: float, now: str) -> DataFrame:
    """Remaining seconds and arrival time of one position bound for a port."""
    row = spark.createDataFrame([(lat, lon % 360, sog, 0.0)], "lat double, lon_360 double, sog double, near_port_flag double")
    row = row.withColumn("dist_to_dest_km", haversine_atan2_km("lat", F.lit(lon), F.lit(port_lat), F.lit(port_lon)))
    out = model.transform(assemble(row)).withColumnRenamed("prediction", "eta_sec")
    return out.select(*FEATURES, "eta_sec", eta_clock(F.lit(now).cast("timestamp"), "eta_sec").alias("arrival"))
