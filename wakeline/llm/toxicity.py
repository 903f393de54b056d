"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed toxic, unlabelled ones those without a label, both outside the held-out
fold; confirmed negatives only give, with the positives, the class prior.  Numpy logistic classifiers are
fitted to the class-prior-corrected risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the
bracket is negative, the step goes against its gradient, so that positives hidden in the unlabelled texts
are not learned as negatives.  The score is the mean classifier's probability.

Features are hashed 5- and 6-grams of the lower-cased text, in which every ASCII character but a-z counts as
a space; present or absent.  Kept are those that enough positives hold and that are at least ``LIFT`` times
as frequent there as in the unlabelled texts, and more frequent by ``SIGMAS`` standard deviations.

The gradient takes about ``max_positive`` and ``max_unlabelled`` documents, chosen by the hash of the id.  A first
screening of the features, at half of ``LIFT`` and ``SIGMAS``, is a join over these; what passes is counted over all
unlabelled texts.  Whole texts of all documents are scored.  Null and empty texts are scored as texts
without features.  Without positives or without features the score is the prior.  Repeated rows are scored
alike, a document with contradictory labels counts under each, an empty table gives no rows, other columns
are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import Scratch, crc_fold, table

LIFT = 3.0
SIGMAS = 5.0
THRESHOLD = 0.7
BAGS = 3
_SALT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


def _grams(text: str) -> list[np.ndarray]:
    """32-bit hashes of all 5-grams, and of all 6-grams, of the text between spaces."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where((c < 128) & ((c < 97) | (c > 122)), np.uint32(32), c).astype(np.uint32)
    h = np.zeros(max(0, len(c) - 4), dtype=np.uint32)
    for k in range(5):
        h = h * np.uint32(0x01000193) + c[k : k + len(h)] * np.uint32(2654435761)
    six = h[:-1] * np.uint32(0x01000193) + c[5:] * np.uint32(2654435761) if len(h) else h
    return [(g ^ (g >> np.uint32(15))) * salt for g, salt in zip((h, six), _SALT, strict=True)]


class Lookup:
    """Position of a hash in a sorted list of them, behind a table of bits that most hashes fail."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.asarray(hashes, dtype=np.uint32)
        self.bits = np.zeros(1 << 18, dtype=bool)
        self.bits[self.hashes >> np.uint32(14)] = True

    def find(self, text: str) -> np.ndarray:
        """Positions of the hashes that occur in the text, each once."""
        out = []
        for g in _grams(text):
            g = g[self.bits[g >> np.uint32(14)]]
            at = np.searchsorted(self.hashes, g)
            at[at == len(self.hashes)] = 0
            out.append(at[self.hashes[at] == g] if len(self.hashes) else at[:0])
        return np.unique(np.concatenate(out))


class Sparse:
    def __init__(self, rows: list[np.ndarray], width: int):
        self.at = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_risk(p: Sparse, u: Sparse, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> np.ndarray:
    """Weights and, last, the intercept, after Adam on the non-negative risk; full batches, no randomness."""
    w = np.zeros(p.width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = su / u.n, -prior * sp / p.n
        grad_negative = np.append(u.back(gu) + p.back(gp), gu.sum() + gp.sum())
        if negative >= 0:
            up = prior * (sp - 1) / p.n
            g = grad_negative + np.append(p.back(up), up.sum())
        else:
            g = -grad_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _share(n: int, most: int):
    """Keeps about ``most`` of ``n`` rows, by the hash of the id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1)))


def fit(scratch: Scratch, docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes of the features, weights with the intercept last, class prior); docs and labels to learn from."""
    totals = labels.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    prior = min(max(totals.p / (totals.p + totals.n), 1e-4), 1 - 1e-4) if totals.p else 1e-4
    none = np.zeros(0, dtype=np.uint32), np.array([np.log(prior / (1 - prior))]), prior
    free = docs.select("doc_id").where("doc_id is not null").join(labels.select("doc_id"), "doc_id", "left_anti")
    free = scratch.cut(free, "unlabelled")
    n_free = free.count()
    if not totals.p or not n_free:
        return none
    chosen = labels.where("toxic = 1").where(_share(totals.p, max_positive)).select("doc_id", F.lit(1).alias("y")).distinct()
    chosen = scratch.cut(chosen.union(free.where(_share(n_free, max_unlabelled)).select("doc_id", F.lit(0).alias("y")).distinct()), "chosen")
    # The table of chosen ids is bounded by max_positive + max_unlabelled.
    sample = scratch.cut(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), "sample")

    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.concatenate(_grams(t or ""))).view(np.int32) for t in texts])

    held = sample.where("y = 1").select(F.explode(F.pandas_udf(whole, "array<int>")("text")).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    n_p = sample.where("y = 1").count()
    n_u = sample.where("y = 0").count()
    if not n_p or not n_u:
        return none
    held = held.where(F.col("c") >= max(4, round(0.004 * n_p)))
    beside = sample.where("y = 0").select(F.explode(F.pandas_udf(whole, "array<int>")("text")).alias("h")).groupBy("h").agg(F.count("*").alias("u"))
    in_p, in_u = F.col("c") / n_p, F.coalesce("u", F.lit(0)) / n_u
    smooth = (F.coalesce("u", F.lit(0)) + 1) / (n_u + 2)
    held = held.join(beside, "h", "left").where((in_p >= LIFT / 2 * in_u) & (in_p - smooth >= SIGMAS / 2 * F.sqrt(smooth / n_p)))
    held = held.select("h", "c").toPandas()
    held = held.assign(h=held["h"].to_numpy(dtype=np.int32).view(np.uint32)).sort_values("h")
    hashes = held["h"].to_numpy()
    if not len(hashes):
        return none
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def known(texts: pd.Series) -> pd.Series:
        lookup = Lookup(sent.value)
        return pd.Series([lookup.find(t or "").astype(np.int32) for t in texts])

    # Texts become positions before the unlabelled ones are told by a join, so that no text is shuffled.
    every = docs.select("doc_id", F.pandas_udf(known, "array<int>")("text").alias("found")).where("size(found) > 0")
    every = every.join(free.withColumnRenamed("doc_id", "_free"), F.col("doc_id") == F.col("_free"), "left_semi")
    common = every.select(F.explode("found").alias("at")).groupBy("at").agg(F.count("*").alias("c")).toPandas()
    in_p, in_u = held["c"].to_numpy() / n_p, np.zeros(len(hashes))
    in_u[common["at"].to_numpy(dtype=np.int64)] = common["c"] / n_free
    smooth = (in_u * n_free + 1) / (n_free + 2)
    keep = np.flatnonzero((in_p >= LIFT * in_u) & (in_p - smooth >= SIGMAS * np.sqrt(smooth / n_p)))
    if not len(keep):
        return none
    kept = docs.sparkSession.sparkContext.broadcast(hashes[keep])

    def chosen_only(texts: pd.Series) -> pd.Series:
        lookup = Lookup(kept.value)
        return pd.Series([lookup.find(t or "").astype(np.int32) for t in texts])

    rows = sample.select("doc_id", "y", F.pandas_udf(chosen_only, "array<int>")("text").alias("x")).toPandas()
    rows = rows.assign(x=[np.asarray(x, dtype=np.int64) for x in rows["x"]]).sort_values(["y", "doc_id"], kind="stable")
    pos, unl = list(rows.loc[rows["y"] == 1, "x"]), list(rows.loc[rows["y"] == 0, "x"])
    p = Sparse(pos, len(keep))
    bags = [fit_risk(p, Sparse(unl[b::BAGS] if len(unl) >= 10 * BAGS else unl, len(keep)), prior) for b in range(BAGS)]
    return hashes[keep], np.mean(bags, axis=0), prior


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (3, 1), max_positive: int = 2000, max_unlabelled: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted.  Fold ``crc32(id) mod held_out[0] = held_out[1]`` teaches nothing."""
    k, out = held_out
    scratch = Scratch(docs.sparkSession, "toxicity")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    hashes, weights, _ = fit(scratch, own.where(crc_fold("doc_id", k) != out), known.where(crc_fold("doc_id", k) != out), max_positive, max_unlabelled)
    model = docs.sparkSession.sparkContext.broadcast((hashes, weights))

    def run(texts: pd.Series) -> pd.Series:
        known, w = model.value
        lookup = Lookup(known)
        return pd.Series(_sigmoid(np.array([w[lookup.find(t or "")].sum() + w[-1] for t in texts], dtype=float)))

    scored = own.select("doc_id", (crc_fold("doc_id", k) == out).alias("held_out"), F.pandas_udf(run, "double")("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
