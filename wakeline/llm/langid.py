"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every ASCII character but a-z counts as a space, and all 1-, 2- and 3-grams of code
points are hashed to ``2**BITS`` buckets.  Counts per language come from labelled rows outside the held-out
fold; the log-probability matrix (buckets x languages) is broadcast and batches are scored in numpy: a text is
its sparse vector of counts, so memory does not grow with text length times languages, and very long texts
are counted piece by piece.

The fit takes about ``max_docs`` labelled rows: all of them if there are no more, otherwise those whose hash
of the id falls below the share that gives this number.  Rows with null text or null language teach nothing.
Null texts and texts without a letter get ``und`` and score 0; so does everything if no row can be learned
from.  Ties go to the language that sorts first.  Repeated rows are scored alike, empty tables give no rows,
other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import crc_fold, table

BITS = 14
CHUNK = 1 << 20
#: A text is judged as if it held this many independent n-grams at most, which keeps scores off 0 and 1.
EFFECTIVE = 40.0
UNKNOWN = "und"


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where((c < 128) & ((c < 97) | (c > 122)), np.uint32(32), c)


def _pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Code points, CHUNK of them at a time and the two that follow; and how many n-grams begin there."""
    for at in range(0, max(len(text), 1), CHUNK):
        c = _codes(text[at : at + CHUNK + 2])
        yield c, len(c) if at + CHUNK >= len(text) else CHUNK


def _grams(c: np.ndarray, own: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that start at the first ``own`` places, for n = 1, 2, 3."""
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(3):
        h = h[: len(c) - n] if n else h
        if len(h) == 0:
            return
        h = h * np.uint32(0x01000193) + c[n:] * np.uint32(2654435761) + np.uint32(n + 1)
        yield (((h[:own] ^ (h[:own] >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    out = np.zeros(1 << BITS, dtype=np.int64)
    for c, own in _pieces(text):
        out += np.bincount(np.concatenate([*_grams(c, own), np.zeros(0, dtype=np.int64)]), minlength=1 << BITS)
    return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", alpha: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and matrix (2**BITS, languages) of log-probabilities."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, own in frame.groupby("lang"):
                total[lang] = total.get(lang, 0) + sum(map(counts, own["text"]))
        for lang, n in total.items():
            at = np.nonzero(n)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    got = rows.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    matrix = np.zeros((1 << BITS, len(langs)))
    matrix[got["bucket"].to_numpy(dtype=np.int64), got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = got["n"]
    logs = np.log((matrix + alpha) / (matrix.sum(axis=0) + alpha * len(matrix)))
    return langs, logs.astype(np.float32)


def predict(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if langs else []
    if not some:
        return out, score
    total, n = np.zeros((len(some), len(langs))), np.zeros(len(some))
    for row, i in enumerate(some):
        found = counts(texts[i])
        at = np.flatnonzero(found)
        total[row], n[row] = found[at] @ matrix[at], found[at].sum()
    logits = total * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i, k, row in zip(some, p.argmax(axis=1), p, strict=True):
        out[i], score[i] = langs[k], row[k]
    return out, score


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (4, 2), max_docs: int = 20_000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if there are columns to ``keep``, a struct ``kept`` of them.  Fold ``crc32(id) mod held_out[0] = held_out[1]`` teaches nothing."""
    spark = docs.sparkSession
    k, out = held_out
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(crc_fold(id_col, k) != out)
    known = known.where("lang is not null and text is not null")
    n = known.count()
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_docs / n))
    model = spark.sparkContext.broadcast(fit(known))

    def run(texts: pd.Series) -> pd.DataFrame:
        pred, score = predict(list(texts), *model.value)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    kept = [F.struct(*keep).alias("kept")] if keep else []
    scored = docs.select(
        F.col(id_col).alias("doc_id"), (crc_fold(id_col, k) == out).alias("held_out"), F.pandas_udf(run, "lang_pred string, score double")(F.col(text_col)).alias("_p"), *kept
    )
    return scored.select("doc_id", "held_out", "_p.lang_pred", "_p.score", *(["kept"] if keep else []))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
