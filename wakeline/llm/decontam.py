"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised by lower-casing A-Z and taking words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window
is ``width`` consecutive words of an item; an item of fewer, but not none, is one window.  Each document is
scanned once; a word inside any occurrence of a window is hit, and hits map back to spans of the original.

The automaton is built on the driver and broadcast.  It does not grow with the documents; a benchmark of more than
``MAX_CHARS`` characters, for which it would not fit, is refused with an error.  Null texts and texts without
words have no hits; items without words never occur; ids of items may be of any type; an item without an id
counts as one item and names none; repeated items count by distinct id, repeated documents one by one; an
empty benchmark leaves all documents clean, an empty table gives no rows, other columns are ignored.
"""

import hashlib
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import table

WIDTH = 8
#: Characters of benchmark text, each of which takes some 100 bytes of the automaton in the driver and in each worker.
MAX_CHARS = 5_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LETTER = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalise(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTER).split()


def windows(text: str | None, width: int = WIDTH) -> list[bytes]:
    words = normalise(text)
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def automaton(items: list[tuple[str | None, str | None]], width: int = WIDTH):
    """Finds windows in a normalised text with a space at either end; values are (words, places).

    A place is (item id, item's row, its words, first word of the window), so that a row's share can be told.
    """
    owners: dict[bytes, list[tuple[str | None, int, int, int]]] = defaultdict(list)
    for row, (item, text) in enumerate(items):
        n = len(normalise(text))
        for at, w in enumerate(windows(text, width)):
            owners[w].append((item, row, n, at))
    found = ahocorasick.Automaton()
    for w, places in owners.items():
        found.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(places)))
    found.make_automaton()
    return found


def scan(words: list[bytes], found) -> tuple[np.ndarray | None, dict[str | None, tuple[float, int]]]:
    """Mask of the words hit (None: none), and for each item with occurring windows the share of its words they cover, and its words."""
    if not words or not len(found):
        return None, {}
    line = f" {b' '.join(words).decode('latin-1')} "
    mask, seen, after = None, {}, None
    for end, (n, own) in found.iter(line):
        if mask is None:
            mask = np.zeros(len(words), dtype=bool)
            after = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(after, end))
        mask[last - n + 1 : last + 1] = True
        seen[own] = n
    held: dict[tuple[str | None, int, int], set[int]] = defaultdict(set)
    for own, n in seen.items():
        for item, row, size, at in own:
            held[item, row, size].update(range(at, at + n))
    shares: dict[str | None, tuple[float, int]] = {}
    for (item, _, size), places in held.items():
        shares[item] = max(shares.get(item, (0.0, 0)), (len(places) / size, size))
    return mask, shares


def spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code points [start, end) of the original text."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at = [m.span() for m in _WORD.finditer(data)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    chars = np.cumsum(np.frombuffer(data + b" ", dtype=np.uint8) & 0xC0 != 0x80) - 1
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[str | None, str]]:
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MAX_CHARS:
        raise ValueError(f"a benchmark of {size} characters; one automaton takes {MAX_CHARS} at most")
    return [(r.i, r.t) for r in rows.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more), hit_spans, items (each with the share of its words that is covered, and its words) and, if there are columns to ``keep``, a struct ``kept`` of them."""
    found = docs.sparkSession.sparkContext.broadcast(automaton(_items(benchmark, item_col, text_col), width))

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = normalise(t)
            mask, ids = scan(words, found.value)
            sha = hashlib.sha256(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest()
            hits = [] if mask is None else [{"start": a, "end": b} for a, b in spans(t, mask)]
            items = [{"item": i, "share": x, "words": n} for i, (x, n) in sorted(ids.items(), key=lambda e: (e[0] is None, e[0]))]
            out.append((len(words), 0 if mask is None else int(mask.sum()), len(ids), sha, hits, items))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "hit_spans", "items"])

    kind = "n_words long, n_hit long, n_items long, items_sha256 string, hit_spans array<struct<start: int, end: int>>, items array<struct<item: string, share: double, words: long>>"
    kept = [F.struct(*keep).alias("kept")] if keep else []
    got = docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, kind)(F.col(text_col)).alias("_p"), *kept)
    return got.select("doc_id", "_p.*", (F.col("_p.n_items") >= 2).alias("contaminated"), *(["kept"] if keep else []))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans", "items")


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT r, p.n, i, item_id FROM place p JOIN win USING (n, s)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS sha FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
