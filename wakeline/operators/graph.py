"""Tables in the shared folder, and connected components built on them."""

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where a local session has none, as in tests, is a folder of our own made; executors would not share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + os.path.join(tempfile.mkdtemp(prefix="wakeline-"), "shared")
    return _OWN_DIR[app]


class Scratch:
    """Tables written to the shared folder.

    A written table cuts lineage: a lost executor costs a re-read of the file, not a recomputation, and the
    file's size gives the planner true statistics.  ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wakeline-{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._wakeline_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._wakeline_path)
            path.getFileSystem(conf).delete(path, True)

    def sweep(self) -> None:
        """Shuffle files of plans that are done with go when the driver collects its garbage; let it do so now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, root)``, root = smallest node of the component.

    Alternates large-star and small-star rounds, which end after O(log^2 n) of them.  Edges and labels stay
    in tables; the driver sees one row of totals per round.  Each round joins edges to a table with one row
    per node, so a hub with very many edges can be split by the skew join.  Self-loops and repeats are
    harmless; null ends are dropped; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = scratch.cut(e.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")
        ).select("p.u", "p.v").where("u > v").distinct()
        new = scratch.cut(small, "edges")
        scratch.drop(e)
        e = new
        total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == seen:
            break
        seen = total
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
