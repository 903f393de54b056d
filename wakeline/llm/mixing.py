"""Mixing sources to target weights by entropy balancing.

Size: words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0).  Sources by code point, null last, take the
weights in turn and share ``budget`` times all sizes; a target stops at ``most`` times its source's size, and
the excess is reshared by weight until none is above.

Rates: of all rates between 0 and ``most`` that meet each source's token constraint, those of least relative
entropy, of copies taken and of copies left, to uniform rates: rate = most * sigmoid(tilt * size / scale).  The odds
are an exponential tilt of the size, which keeps rates below ``most`` where a plain one would have to be cut.
The dual in the tilts is convex and separates by source; Newton iterations, safeguarded by bisection, solve
it.  Each is one distributed aggregate over the (source, size) counts, which documents enter only once.

Copies: documents of one (source, size) cell have one rate, and get whole copies that sum to the cell's
share; the fractions left are settled per source from the largest size down, so that a source ends within
about its smallest size of its target.  Which documents of a cell get the odd copies follows from a hash of
id and text, ranked within shares of a cell of about ``SHARE`` documents each.  That is settled on hashes, and
leaves one edge for each share; the documents are read a second time and held against it, so texts travel
only where the edges are too many for Spark to send them to all executors.

A source without words has target and taken 0.  Repeated rows count one by one; which of them get odd copies goes by
``extra`` columns too.  Tilts that do not settle are an error.  The result is the same at every run; an empty table gives no rows; other columns are ignored unless asked for.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import Scratch, table

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2
SHARE = 250
ROUNDS = 40


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size) -> and target, by water-filling: one row per source, so two ordered windows do."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights)).cast("int") + 1)
    s = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    # With sources by cap / w, the level is set by the first source that stays below its cap.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * float(budget)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)
    s = s.withColumn("level", level["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def tilts(scratch: Scratch, cells: DataFrame, sources: DataFrame, most: float = MOST, tolerance: float = 1e-7) -> DataFrame:
    """(source, tilt, scale): Newton iterations on the dual of all sources at once."""
    size = sources.join(cells.groupBy("source").agg(F.max("size").alias("top")), "source")
    state = size.select("source", "target", F.col("top").cast("double").alias("scale"), F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("off"))
    state = scratch.cut(state, "tilts")
    for _ in range(ROUNDS):
        rate = float(most) / (1 + F.exp(-F.least(F.greatest(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(-700.0)), F.lit(700.0))))
        x = F.col("size") / F.col("scale")
        now = (
            cells.join(state, "source")
            .groupBy("source", "target", "scale", "tilt", "lo", "hi")
            .agg(F.sum(F.col("n") * x * rate).alias("got"), F.sum(F.col("n") * x * x * rate * (1 - rate / float(most))).alias("slope"))
        )
        gap = F.col("got") - F.col("target") / F.col("scale")
        now = now.withColumn("gap", gap).withColumn("lo", F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - F.try_divide("gap", "slope")
        inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step - F.col("tilt")) < 50), F.lit(False))
        middle = F.when((F.col("lo") > -1e6) & (F.col("hi") < 1e6), (F.col("lo") + F.col("hi")) / 2).otherwise(
            F.when(F.col("gap") < 0, F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise(F.least(F.col("tilt") * 2, F.lit(-1.0)))
        )
        off = F.coalesce(F.abs(F.try_divide(F.col("gap") * F.col("scale"), "target")), F.lit(0.0))
        new = now.withColumn("off", off).select(
            "source", "target", "scale", F.when(F.col("off") <= tolerance, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"), "lo", "hi", "off"
        )
        new = scratch.cut(new, "tilts")
        scratch.drop(state)
        state = new
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"tilts did not settle: a source is off its target by a share of {worst}")
    return state.select("source", "tilt", "scale")


def settle(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of each cell of a source, from the largest size down; bounded by the number of sizes."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    size, n, share = cells["size"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), cells["share"].to_numpy(np.float64)
    copies, debt = np.zeros(len(size), dtype=np.int64), 0.0
    for i in range(len(size)):
        if size[i] == 0:
            copies[i] = n[i]
            continue
        want = share[i] + debt / size[i]
        copies[i] = min(max(int(np.floor(want + 0.5)), 0), MOST * int(n[i]))
        debt = (want - copies[i]) * size[i]
    return pd.DataFrame({"source": cells["source"], "size": size, "copies": copies})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, and ``extra`` columns of the documents."""
    scratch = Scratch(docs.sparkSession, "mixing")
    tie = F.xxhash64(*(F.col(c) for c in extra)) if extra else F.lit(0).cast("long")

    def rows(*more: Column) -> DataFrame:
        own = (F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("h"))
        return docs.select(*own, tie.alias("tie"), *more)

    # Decisions are made without the texts; repeated rows are one with a count.
    own = scratch.cut(rows().groupBy("doc_id", "source", "size", "h", "tie").agg(F.count("*").alias("m")), "sizes")
    cells = scratch.cut(own.groupBy("source", "size").agg(F.sum("m").alias("n")), "cells")
    sources = scratch.cut(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget), "targets")
    # Numbers stand for sources in the joins: a null source joins like any other.
    number = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    number = scratch.cut(number, "numbered")
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    coded = cells.alias("c").join(number.alias("s"), same).select(F.col("s.source_no").alias("source"), "c.size", "c.n", "s.target")
    coded = scratch.cut(coded, "coded")
    # At its cap a source takes every document at the highest rate; no finite tilt does that.
    full = F.col("target") >= F.col("source_size") * float(MOST) * (1 - 1e-9)
    live = number.where((F.col("source_size") > 0) & ~full).select(F.col("source_no").alias("source"), "target")
    tilt = tilts(scratch, coded.drop("target").where("size > 0"), live)
    rate = float(MOST) / (1 + F.exp(-F.least(F.greatest(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(-700.0)), F.lit(700.0))))
    shared = coded.join(tilt, "source", "left").select("source", "size", "n", (F.col("n") * F.when(F.col("tilt").isNull(), float(MOST)).otherwise(rate)).alias("share"))
    copies = shared.groupBy("source").applyInPandas(settle, "source int, size long, copies long")
    copies = scratch.cut(coded.join(copies, ["source", "size"]).select("source", "size", "n", "copies"), "copies")

    # Every document of a cell gets copies div n; the odd ones go by the hash of id and text, dealt to the cell's parts.
    every = copies.withColumn("parts", F.greatest(F.expr(f"n div {SHARE}"), F.lit(1))).withColumnRenamed("source", "source_no").join(number, "source_no")
    every = scratch.cut(every.select("source_no", F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "copies", "parts", "source_size", "target"), "every")

    def placed(given: DataFrame) -> DataFrame:
        found = given.join(every, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
        return found.withColumn("part", F.pmod(F.col("h"), F.col("parts"))).drop("source", "_source", "_size")

    cell = ("source_no", "size")
    held = placed(own)
    dealt = held.groupBy(*cell, "part").agg(F.sum("m").alias("held"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    upto = Window.partitionBy(*cell).orderBy("part")
    dealt = dealt.withColumn("to", F.sum("held").over(upto)).withColumn("odd", F.expr("copies - (copies div n) * n"))
    dealt = dealt.select(*cell, "part", F.expr("(to * odd) div n - ((to - held) * odd) div n").alias("odd_here")).where("odd_here > 0")
    # The edge of a part is the row that takes its last odd copy: the rows before it take one each, and of the
    # rows equal to it as many as are left.
    order = Window.partitionBy(*cell, "part").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    edges = held.select(*cell, "part", "h", "doc_id", "tie", "m").join(dealt, [*cell, "part"]).withColumn("to", F.sum("m").over(order))
    edges = edges.where("to >= odd_here and to - m < odd_here").withColumn("left", F.expr("odd_here - to + m"))
    edges = edges.select(*cell, "part", F.struct("h", "doc_id", "tie").alias("edge"), "left", (F.col("left") < F.col("m")).alias("torn"))
    edges = scratch.cut(edges, "edges")

    doc = placed(rows(*(F.col(c).alias(f"_x_{c}") for c in extra))).join(edges, [*cell, "part"], "left")
    key = F.struct("h", "doc_id", "tie")
    odd = F.when(key <= F.col("edge"), 1).otherwise(0)
    if edges.where("torn").isEmpty():
        doc = doc.withColumn("odd", odd)
    else:
        torn = F.coalesce(F.col("torn") & key.eqNullSafe(F.col("edge")), F.lit(False))
        rank = F.row_number().over(Window.partitionBy(*cell, "part").orderBy("h"))
        doc = doc.where(~torn).withColumn("odd", odd).unionByName(doc.where(torn).withColumn("odd", F.when(rank <= F.col("left"), 1).otherwise(0)))
    doc = doc.withColumn("copies", F.expr("copies div n") + F.col("odd"))
    return doc.select("doc_id", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(F.col(f"_x_{c}").alias(c) for c in extra))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
