"""Personal data: fixed patterns, then information-theoretic sanitisation of the terms around them.

Patterns (leftmost, non-overlapping for each kind, no retries): email, ip (parts at most 255), card (12 to 19
digits that pass Luhn), phone (9 to 15 digits).  Every match is a mention of an entity, kind and normalised
value.

Sanitisation: a term is a lower-cased run of letters; it co-occurs with an entity if it stands within
``REACH`` terms of one of its mentions.  Over the whole corpus, in distinct texts, let c be the texts in
which a term co-occurs with an entity, d and e the texts that hold the term and the entity, and N all of
them.  The term discloses log2(c N / (d e)) of the log2(N / e) bits that identify the entity.  With c of at
least ``MIN_SUPPORT``, or of all e texts of an entity that has fewer, and that share at least ``DISCLOSES``,
the term is sanitised wherever it stands in a text that holds the entity, near a mention or not: a span of
kind ``term``.  Where c is less than
``MIN_SUPPORT``, d is taken ``SMOOTH`` higher: of a few texts, the rarity of a term is less sure.  Copies of one text
count once, so a copied text is no evidence.

Null and empty texts have no spans; repeated rows are treated alike, each for itself; a null id is kept; an
empty table gives no rows; other columns are ignored unless asked for.
"""

import re
from bisect import bisect_left, bisect_right
from itertools import islice

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import Scratch, small_batches, table

KINDS = ("email", "ip", "card", "phone")
REACH = 6
MIN_SUPPORT = 5
DISCLOSES = 0.9
SMOOTH = 0.5
#: Candidate terms that are broadcast to count them over the corpus; more are joined by a shuffle.
MAX_BROADCAST = 200_000
#: What a span is generalised to.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

# A run of digits or of address characters is entered at its start only; entering it later could not succeed
# where its start fails, and would make long runs quadratic.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The same letters as those of ``_terms``, which takes the corpus apart in the engine.
_TERM = regex.compile(r"\p{L}+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, normalised value), by start, then kind as listed."""
    out, done = [], 0
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            m = _DOMAIN.match(text, at) if start < at else None
            if m:
                done = m.end()
                out.append((start, "email", done, text[start:done].lower()))
            at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), "ip", m.end(), m[0]))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 9 <= len(digits) <= 15:
                out.append((m.start(), "phone", m.end(), digits))
    out.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return out


def _gaps(text: str, spans: list[tuple[int, str, int, str]]) -> list[tuple[int, int]]:
    """The stretches outside all spans, in order; between overlapping spans there is none."""
    out, done = [], 0
    for start, _, end, _ in spans:
        if start > done:
            out.append((done, start))
        done = max(done, end)
    if done < len(text):
        out.append((done, len(text)))
    return out


def _around(text: str, spans: list[tuple[int, str, int, str]]) -> list[dict]:
    """Terms within REACH terms of each mention on either side, outside all spans.

    A stretch between spans matters by its first and last REACH terms only, so these are listed once for each,
    and the work is linear in the text however many mentions it holds.
    """
    first, last = [], []
    for lo, hi in _gaps(text, spans):
        first += [m.span() for m in islice(_TERM.finditer(text, lo, hi), REACH)]
        tail = [m.span() for m in islice(_TERM.finditer(text[lo:hi][::-1]), REACH)]
        last += [(hi - b, hi - a) for a, b in reversed(tail)]
    starts, ends = [a for a, _ in first], [b for _, b in last]
    out, seen = [], set()
    for start, kind, end, value in spans:
        entity = xxhash.xxh64_intdigest(f"{kind}:{value}", 7) - (1 << 63)
        after, before = bisect_left(starts, end), bisect_right(ends, start)
        for a, b in (*last[max(0, before - REACH) : before], *first[after : after + REACH]):
            if (entity, a) not in seen:
                seen.add((entity, a))
                out.append({"entity": entity, "term": text[a:b].lower(), "start": a, "end": b})
    return out


def _analyse(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        t = t or ""
        spans = base_spans(t)
        out.append((
            [{"start": s, "kind": k, "end": e} for s, k, e, _ in spans],
            _around(t, spans) if spans else [],
            xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) if spans else 0,
        ))
    return pd.DataFrame(out, columns=["base", "near", "text_hash"])


_SPAN = "array<struct<start: int, kind: string, end: int>>"
_ANALYSED = f"base {_SPAN}, near array<struct<entity: long, term: string, start: int, end: int>>, text_hash long"


def _everywhere(texts: pd.Series, bases: pd.Series, terms: pd.Series) -> pd.Series:
    """Spans of all occurrences of the terms outside the base spans."""
    out = []
    for text, base, wanted in zip(texts, bases, terms, strict=True):
        known = set(wanted)
        gaps = _gaps(text, [(s["start"], "", s["end"], "") for s in base])
        found = (m for lo, hi in gaps for m in _TERM.finditer(text, lo, hi))
        out.append([{"start": m.start(), "kind": "term", "end": m.end()} for m in found if m[0].lower() in known])
    return pd.Series(out, dtype=object)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.split(text, r"[^\p{L}]+"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, discloses: float = DISCLOSES) -> DataFrame:
    """doc_id, row (unique), base spans and all spans, both by start, then kind as listed and ``term`` last, and body, the text if it has spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    seen = docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(_analyse, _ANALYSED)(F.col(text_col)).alias("p"), F.col(text_col).alias("text"))
    body = F.when(F.size("p.base") > 0, F.col("text")).alias("body")
    with small_batches(scratch.spark):
        seen = scratch.cut(seen.select("doc_id", "p.*", body, F.monotonically_increasing_id().alias("row")), "analysed")
    near = seen.where("size(near) > 0").select("row", "text_hash", F.explode("near").alias("n")).select("row", "text_hash", "n.*")
    total = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h")).distinct().count()
    pairs = near.select("entity", "term", "text_hash").distinct()
    support = pairs.groupBy("entity", "term").agg(F.count("*").alias("c"))
    holds = near.select("entity", "text_hash").distinct().groupBy("entity").agg(F.count("*").alias("e"))
    # The texts in which a term stands near any entity are among those that hold it: a term that is too common
    # there discloses nothing, and needs no count over the whole corpus.
    beside = near.select("term", "text_hash").distinct().groupBy("term").agg(F.count("*").alias("d"))
    smooth = f"(d + if(c < {min_support}, {SMOOTH}, 0))"
    share = f"c >= least({min_support}, e) and log2(c * n / ({smooth} * e)) >= {discloses} * log2(n / e) and n > e"
    support = support.join(beside, "term").join(holds, "entity").withColumn("n", F.lit(float(max(total, 1)))).where(share)
    support = scratch.cut(support.drop("d"), "support")
    flagged = None
    if not support.isEmpty():
        wanted = scratch.cut(support.select("term").distinct(), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
        texts = docs.select(F.xxhash64(text_col).alias("h"), F.explode(_terms(F.col(text_col))).alias("term")).withColumn("term", F.lower("term"))
        held = texts.join(wanted, "term").distinct().groupBy("term").agg(F.count("*").alias("d"))
        flagged = scratch.cut(support.join(held, "term").where(share).select("entity", "term"), "flagged")
    if flagged is None:
        return seen.select("doc_id", "row", "base", F.col("base").alias("spans"), "body")
    # An entity with any term in its text has terms near it, so ``near`` knows the texts of each.
    told = near.select("row", "entity").distinct().join(flagged, "entity").groupBy("row").agg(F.collect_set("term").alias("terms"))
    held = seen.where("body is not null").join(told, "row").select("row", F.pandas_udf(_everywhere, _SPAN)("body", "base", "terms").alias("more"))
    # A filter on what is not written yet would evaluate it a second time, with Python workers of its own.
    with small_batches(scratch.spark):
        more = scratch.cut(held, "more").where("size(more) > 0")
    k = "array('email', 'ip', 'card', 'phone', 'term')"
    order = F.expr(
        "array_sort(concat(base, coalesce(more, array())), (a, b) -> case when a.start <> b.start then a.start - b.start "
        f"else cast(array_position({k}, a.kind) - array_position({k}, b.kind) as int) end)"
    )
    return seen.join(more, "row", "left").select("doc_id", "row", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(order).alias("spans"), "body")


def _join(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def report(found: DataFrame) -> DataFrame:
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(_join("base"), 256).alias("base_sha256"), _join("spans").alias("spans"))


def redact(text: str | None, spans) -> str | None:
    """The text with each span generalised to its label; of overlapping spans, one label for their union."""
    if text is None or spans is None or len(spans) == 0:
        return text
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            out += [text[done : s["start"]], LABELS[s["kind"]]]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their texts sanitised, columns and rows kept.  Rows of one id share their text's spans by text, not by id."""
    found = find(docs.select(F.md5(text_col).alias("doc_id"), F.col(text_col)), "doc_id", text_col).where("size(spans) > 0")
    found = found.groupBy("doc_id").agg(F.first(F.struct("body", "spans")).alias("s"))
    scratch = Scratch(docs.sparkSession, "pii")
    with small_batches(scratch.spark):
        found = scratch.cut(found.select(F.col("doc_id").alias("key"), F.pandas_udf(_redact_pair, "string")("s.body", "s.spans").alias("redacted")), "redacted")
    # The rest of a row goes along as a struct, whatever its columns are called.
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text"), F.struct(F.lit(0), *rest).alias("rest"))
    out = keyed.join(found, "key", "left").withColumn("text", F.coalesce("redacted", "text"))
    return out.select(*(F.col("text" if c == text_col else f"rest.`{c}`").alias(c) for c in docs.columns))


def _redact_pair(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(table(spark, sf_dir, "documents")))
