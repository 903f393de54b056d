"""Near-duplicates at a Jaccard similarity, found by the deletion-variant signatures of long SimHash fingerprints.

Words are those of ``simhash``; a text is the set of its shingles of ``width`` words (fewer words: the whole
sequence).  A fingerprint bit says whether more than half of the set's hashes have it.  Two sets of similarity
``least`` differ in a share p of their bits, arccos(2 least / (1 + least)) / pi; the fingerprint is cut into so
many segments that with a probability of ``RECALL`` two such sets differ by one bit or none in one of them.
Every segment is indexed under its one-wildcard variants, an equality join finds texts that share one, and
what it finds is checked: the sizes, 128 bits kept for that, at last the sets themselves.  A bit differs where
the count is near half in both texts, so only the ``WEAK`` most even bits of a segment become wildcards.

A segment has four bits more than numbers the texts, ``BITS`` at least, so chance meetings stay in proportion to
the texts whatever their number; the segments needed for the same recall follow from that.

Texts with the same set are one from the start.  Segments that are wholly equal come first: most copies meet in
one, and those that go do not crowd the variants.  A key that two or three share, which counting them tells
before any shuffle of texts, gives pairs.  One that more share is no all-pairs group: up to ``CROWD`` are compared
with each other, and in larger ones all with the first and the last; the similar ones go, and the rest is taken
again, until nothing goes; what is left then, texts alike in a segment and not in their sets, is compared in full.
No two sets are compared twice.
"""

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import Scratch, components, small_batches
from wakeline.llm.simhash import _hashes

WIDTH = 5
LEAST = 0.8
RECALL = 0.94
BITS = 22
WEAK = 8
CROWD = 16
#: Segments whose variants are shuffled at a time, which bounds the disk they need.
AT_ONCE = 5
#: Bits kept for the check, two longs.
CHECK = 128
#: Standard deviations of the bits kept for the check that a similar pair may differ by.
SIGMAS = 4.0
_BLOCK = 1 << 14


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    parts = list(_hashes((text or "").encode("utf-8", "surrogatepass"), width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def differing(least: float) -> float:
    """Share of bits that differ between two sets of equal size and this similarity."""
    return math.acos(2 * least / (1 + least)) / math.pi


def shape(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int, int]:
    """(segments, bits of each, wildcards of each) for ``n`` texts."""
    bits = min(max(math.ceil(math.log2(max(n, 2))) + 4, BITS), 31)
    p = differing(least)
    one = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - one)), bits, min(WEAK, (63 - bits) // 5)


def _mixers(words: int) -> np.ndarray:
    """An odd multiplier for each word of the fingerprint."""
    return np.random.default_rng(64).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _leanings(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, how many more of the hashes have it than not."""
    total = np.zeros(64 * len(odd), dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        h = hashes[at : at + _BLOCK, None] * odd
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        # Bytes hold counts up to 255, so eight of them are added at once.
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").view(np.uint64)
        whole = len(bits) // 255 * 255
        lanes = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint64)
        rest = bits[whole:].sum(axis=0, dtype=np.uint64)[None]
        total += np.concatenate([lanes, rest]).view(np.uint8).sum(axis=0, dtype=np.int64)
    return 2 * total - len(hashes)


def signature(hashes: np.ndarray, segments: int, bits: int, weak: int, odd: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The 128 bits for the check, and for each segment its value and, above it, five bits for each wildcard's place."""
    lean = _leanings(hashes, odd)
    check = np.packbits(lean[:CHECK] > 0, bitorder="little").view("<i8").tolist()
    lean = lean[CHECK : CHECK + segments * bits].reshape(segments, bits)
    value = (lean > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    places = np.sort(np.argsort(np.abs(lean), axis=1, kind="stable")[:, :weak], axis=1)
    return check, value | (places << (bits + 5 * np.arange(weak))).sum(axis=1)


def _prints(docs: DataFrame, width: int, segments: int, bits: int, weak: int) -> DataFrame:
    """(row, id, alone, n, digest, w, x, segs)"""

    def run(texts: pd.Series) -> pd.DataFrame:
        odd, out = _mixers(CHECK // 64 + -(-segments * bits // 64)), []
        for t in texts:
            h = shingles(t, width)
            check, segs = signature(h, segments, bits, weak, odd)
            out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), *check, segs))
        return pd.DataFrame(out, columns=["n", "digest", "w", "x", "segs"])

    made = F.pandas_udf(run, "n int, digest binary, w long, x long, segs array<long>")("text")
    return docs.select("row", "id", "alone", made.alias("p")).select("row", "id", "alone", "p.*")


def _wholes(prints: DataFrame, bits: int) -> DataFrame:
    """(key, row): each segment.  Rows that are ``alone`` have keys of their own."""
    each = prints.select("row", "alone", F.posexplode("segs").alias("t", "s"))
    key = f"(shiftleft(cast(t as bigint), 32) | (s & {(1 << bits) - 1}))"
    return each.select(F.expr(f"if(alone, ~{key}, {key})").alias("key"), "row")


def _variants(prints: DataFrame, bits: int, weak: int, lo: int = 0, hi: int = 1 << 30) -> DataFrame:
    """(key, row): each segment, or those from ``lo`` to before ``hi``, without one bit.  Rows that are ``alone`` have keys of their own."""
    each = prints.select("row", "alone", F.posexplode("segs").alias("t", "s")).where(f"t >= {lo} and t < {hi}")
    place = [f"(shiftright(s, {bits + 5 * j}) & 31)" for j in range(weak)]
    keys = [f"(shiftleft(t * 32 + {p}, 32) | (s & {(1 << bits) - 1} & ~shiftleft(1L, cast({p} as int))))" for p in place]
    keys = F.explode(F.expr(f"array({', '.join(keys)})")).alias("key")
    return each.select("row", "alone", keys).select(F.expr("if(alone, ~key, key)").alias("key"), "row")


def _shared(rows: DataFrame) -> DataFrame:
    """(key, c, a, b, x): the keys that more than one row has, how many, the first, the last, and the third of three."""
    own = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("row").alias("a"), F.max("row").alias("b"), F.bit_xor("row").alias("x"))
    return own.where("c > 1").select("key", "c", "a", "b", F.expr("if(c = 3, x ^ a ^ b, a)").alias("x"))


def _verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, width: int, least: float) -> DataFrame:
    """The pairs (u, v) of rows that are similar."""
    rows = scratch.cut(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct(), "ends")
    data = F.pandas_udf(lambda ts: pd.Series([shingles(t, width).tobytes() for t in ts]), "binary")
    # Rows of one text and id are one row here.
    texts = docs.join(rows, "row", "left_semi").select("row", data("text").alias("s"))
    with small_batches(scratch.spark):
        sets = scratch.cut(texts.groupBy("row").agg(F.max("s").alias("s")), "sets")

    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least - 1e-9 for x, y in zip(a, b, strict=True)], dtype=bool)

    left, right = sets.select(F.col("row").alias("v"), F.col("s").alias("sv")), sets.select(F.col("row").alias("u"), F.col("s").alias("su"))
    with small_batches(scratch.spark):
        out = scratch.cut(pairs.join(left, "v").join(right, "u").where(F.pandas_udf(near, "boolean")("su", "sv")).select("u", "v"), "similar")
    scratch.drop(sets)
    return out


def _close(least: float) -> Callable[[str, str], str]:
    """SQL: whether two rows' sizes and check bits allow the similarity."""
    p = differing(least)
    most = math.floor(CHECK * p + SIGMAS * math.sqrt(CHECK * p * (1 - p)))
    return lambda a, b: f"{a}.n >= {least} * {b}.n - 1e-6 and {b}.n >= {least} * {a}.n - 1e-6 and bit_count({a}.w ^ {b}.w) + bit_count({a}.x ^ {b}.x) <= {most}"


def removed(docs: DataFrame, width: int = WIDTH, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """The column ``row`` of the rows that go: of each group of similar rows, all but the one with the smallest id.

    ``docs`` has ``row``, a number that rows of one id and text share, ``id``, ``text``, and ``alone``, which tells
    two parts of the rows; rows of different parts are not compared.  Groups are closed under similarity; of a
    group that comes together in steps, the later ones see only the rows that are left.  Texts without a word
    are alike.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "nearcopies")
    segments, bits, weak = shape(docs.count(), least, recall)
    with small_batches(scratch.spark):
        prints = scratch.cut(_prints(docs, width, segments, bits, weak), "prints")
    first = prints.groupBy("alone", "digest").agg(F.min(F.struct(F.isnull("id"), "id", "row")).alias("s")).select("s.row")
    alive = scratch.cut(prints.join(first, "row", "left_semi").dropDuplicates(["row"]), "distinct")
    went = [scratch.cut(prints.select("row").join(alive, "row", "left_anti").distinct(), "same")]
    scratch.drop(prints)
    named = alive.select("row", "id")
    size = alive.select("row", F.struct("n", "w", "x").alias("p"))
    close = _close(least)

    checked: list[DataFrame] = []

    def fresh(pairs: DataFrame) -> DataFrame:
        """Of the pairs, those whose sets were not compared yet."""
        for t in checked:
            pairs = pairs.join(t, ["u", "v"], "left_anti")
        return pairs

    def met(pairs: DataFrame) -> DataFrame:
        """Of the pairs (u, v), once each, those that are close and were not compared yet."""
        ends = [size.select(F.col("row").alias(e), F.col("p").alias(f"p{e}")) for e in ("u", "v")]
        pairs = fresh(pairs.where("u <> v").selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct())
        return pairs.join(ends[0], "u").join(ends[1], "v").where(close("pu", "pv")).select("u", "v")

    def go(pairs: DataFrame) -> DataFrame:
        """The rows that go, given all close pairs."""
        checked.append(scratch.cut(pairs, "pairs"))
        similar = _verified(docs, checked[-1], scratch, width, least)
        if similar.isEmpty():
            return similar.select(F.col("u").alias("row"))
        roots = scratch.cut(components(scratch, similar).join(named.withColumnRenamed("row", "node"), "node"), "roots")
        stay = roots.groupBy("root").agg(F.min(F.struct(F.isnull("id"), "id", "node")).alias("s")).select("s.node")
        return scratch.cut(roots.join(stay, "node", "left_anti").select(F.col("node").alias("row")), "found")

    def few(shared: DataFrame) -> DataFrame:
        two = shared.where("c <= 3").selectExpr("a as u", "b as v")
        third = F.explode(F.array("a", "b")).alias("v")
        return two.union(shared.where("c = 3").select(F.col("x").alias("u"), third))

    def crowded(rows: DataFrame, shared: DataFrame) -> DataFrame:
        """(key, c, a, b, row): the rows of keys that more than three share.

        The keys are a table of their own, whose size tells the planner whether all rows must be shuffled again.
        """
        keys = scratch.cut(shared.where("c > 3").drop("x"), "keys")
        return scratch.cut(rows.join(keys, "key").select("key", "c", "a", "b", "row"), "crowd")

    def stars(crowd: DataFrame) -> DataFrame:
        return crowd.select(F.col("row").alias("u"), F.explode(F.array("a", "b")).alias("v"))

    rows = _wholes(alive, bits)
    shared = scratch.cut(_shared(rows), "shared")
    gone = go(met(few(shared).union(stars(crowded(rows, shared)))))
    went.append(gone)

    rest = scratch.cut(alive.join(gone, "row", "left_anti"), "rest")
    full = False
    # A few segments at a time, whose shuffle files go before the next ones come; keys of two segments differ.
    shared, crowd = [], []
    for at in range(0, segments, AT_ONCE):
        rows = _variants(rest, bits, weak, at, at + AT_ONCE)
        shared.append(scratch.cut(_shared(rows), "shared"))
        crowd.append(crowded(rows, shared[-1]))
        scratch.sweep()
    shared, crowd = reduce(DataFrame.union, shared), reduce(DataFrame.union, crowd)
    while True:
        small = crowd if full else crowd.where(f"c <= {CROWD}")
        small = scratch.cut(small.join(size, "row").select("key", "row", "p"), "small")
        pairs = small.alias("s").join(small.alias("t"), F.expr(f"s.key = t.key and s.row < t.row and {close('s.p', 't.p')}")).selectExpr("s.row as u", "t.row as v")
        many = crowd.where("false" if full else f"c > {CROWD}")
        found = go(met(few(shared).union(stars(many))).union(fresh(pairs.distinct())).distinct())
        went.append(found)
        if full or many.isEmpty():
            break
        full = found.isEmpty()
        rows = scratch.cut(many.select("key", "row").join(found, "row", "left_anti"), "rest")
        shared = scratch.cut(_shared(rows), "shared")
        crowd = crowded(rows, shared)
    gone = scratch.cut(reduce(DataFrame.union, went), "gone")
    scratch.drop(alive)
    return gone
