"""SimHash near-duplicate detection by deletion-variant signatures.

Contract of ``near_duplicates``: A-Z are lower-cased in the whole text, words are ``[^\\x20\\x09-\\x0D]+``,
shingles are ``width`` consecutive words joined by a space, repeats included (fewer words: the whole
sequence).  A bit of the fingerprint is 1 if it is set in more than half of the shingles' XXH64 (seed 42).
Null, empty and blank texts have fingerprint zero, linked like any other.  Fingerprints link at
``<= 2`` differing bits.  Repeated rows and repeated ids are kept; a null id stays null and never names a
component unless all ids in it are null.  An empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import Scratch, components, table

BLOCK = 1 << 15


def _hashes(data: bytes, width: int):
    """XXH64 of each shingle, in blocks, so that a very long text needs bounded memory."""
    words = data.lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if not words:
        return
    if len(words) <= width:
        yield np.array([digest(join(words), 42)], dtype=np.uint64)
        return
    for at in range(0, len(words) - width + 1, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        yield np.array([digest(join(s), 42) for s in zip(*(part[k:] for k in range(width)), strict=False)], dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for h in _hashes((text or "").encode("utf-8", "surrogatepass"), width):
        n += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0]) if n else 0


def fingerprint_column(text: str, width: int = 3):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(F.col(text))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the upper half with each bit deleted in turn, and whole, and the lower half whole.

    Two fingerprints at <= 2 bits differ by at most one bit in one of the halves.  If that half is the upper
    one, they share an upper key; otherwise the upper halves differ by two bits and the lower ones are equal.
    """
    upper = "shiftrightunsigned(fp, 32)"
    wild = [f"(shiftleft({i + 1}L, 32) | ({upper} & {0xFFFFFFFF ^ (1 << i)}L))" for i in range(32)]
    keys = [f"({upper})", *wild, f"(shiftleft(33L, 32) | (fp & {0xFFFFFFFF}L))"]
    return fps.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), "fp")


def links(scratch: Scratch, fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links at <= 2 bits.

    A key that two fingerprints share gives one pair, which is verified.  Fingerprints of a key shared by more
    go through a second index, the fingerprint itself and its 64 one-bit neighbours: two fingerprints are
    within two bits exactly if they share such a point, a point is shared by 65 at most, and all that share
    it are within two bits of each other, so a star replaces the pairs.  Work is linear in fingerprints.
    """
    variants = _variants(fps)
    shared = (
        variants.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where("n > 1")
    )
    shared = scratch.cut(shared, "shared")
    pairs = shared.where("n = 2").select("u", "v").where("bit_count(u ^ v) <= 2").distinct()
    crowded = variants.join(shared.where("n > 2").select("key"), "key", "left_semi").select("fp").distinct()
    crowded = scratch.cut(crowded, "crowded")
    near = ", ".join(["fp", *(f"(fp ^ shiftleft(1L, {i}))" for i in range(64))])
    points = crowded.select(F.explode(F.expr(f"array({near})")).alias("point"), "fp")
    stars = (
        points.groupBy("point")
        .agg(F.min("fp").alias("u"), F.collect_set("fp").alias("vs"))
        .where("size(vs) > 1")
        .select("u", F.explode("vs").alias("v"))
        .where("u <> v and bit_count(u ^ v) <= 2")
        .distinct()
    )
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(text_col, width).alias("fp"))
    fp = scratch.cut(fp, "fingerprints")
    fps = scratch.cut(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(scratch, links(scratch, fps.select("fp")))
    member = scratch.cut(fps.join(roots, fps.fp == roots.node).select("fp", "rep", "root"), "members")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    named = scratch.cut(
        fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "named"
    )
    return fp.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
