"""Main-text extraction from HTML by the maximum-scoring subsequence.

A page is a sequence of words and tags.  A tag's weight is negative and a word's positive; both come from
labelled pages, which are those that mark their article with an ``article`` or ``main`` element: a token
class (a tag's name, or the name of the element a word stands in) weighs the smoothed log-odds of standing
inside, pushed to its sign.  A linear scan finds the contiguous run of tokens with the highest sum.

The run is then settled on the element whose words agree with it best, if they agree well; otherwise the run
itself is the region.  Of the region, elements that are no article text are left out: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, and what is hidden.  Character
references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
newlines in page order, and empty ones are dropped.

The fit takes about ``max_pages`` pages, by the hash of the id.  Null and empty pages, and pages without a
word, have an empty text.  Broken markup is read as far as it goes: a missing end tag ends with its parent.
Repeated rows are treated alike, an empty table gives no rows, other columns are ignored.
"""

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title|button)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|[^<]++|<",
    re.DOTALL | re.IGNORECASE,
)
_REST = re.compile(r"[^<]++|<!--.*\Z|<[!?].*\Z|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never article text.
OUTSIDE = frozenset("nav footer aside form head menu dialog input label".split())
#: Words of class, id and role that mark the same.
_OUTSIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|"
    r"cookies?|consent|notice|newsletter|subscribe|popup|modal|comments?|disqus|replies|related|recommend\w*|share|sharing|social|widget|login|search|toolbar|complementary|contentinfo)(?=$|[\s_-])",
    re.IGNORECASE,
)
_PARAGRAPH_END = BLOCK - {"br"}
_CONTAINERS = frozenset("html body div article main section aside nav header footer form td th li blockquote dd figure ul ol table".split())
_AGREES = 0.9


def _outside(name: str, attributes: str) -> bool:
    if name in OUTSIDE:
        return True
    if not attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main") and _OUTSIDE_NAME.search(value.strip("\"'")):
            return True
        if key == "aria-hidden" and "true" in value.lower() or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes))


class Page:
    """Tokens of a page: ``kinds`` (class of each), ``texts`` (None for a tag), ``skips``, and element ranges."""

    def __init__(self, source: str):
        self.kinds: list[str] = []
        self.texts: list[str | None] = []
        self.skips: list[bool] = []
        self.elements: list[list] = []
        # (name, element, skipped, place of the paragraph and of the list item that a new block ends, or -1)
        stack: list[tuple[str, int, bool, int, int]] = []
        within: Counter = Counter()

        def close(upto: int) -> None:
            while len(stack) > upto:
                name, k, *_ = stack.pop()
                within[name] -= 1
                self.elements[k][2] = len(self.kinds)

        def add(kind: str, text: str | None) -> None:
            self.kinds.append(kind)
            self.texts.append(text)
            self.skips.append(bool(stack) and stack[-1][2])

        # Past the last ">" no tag can end, and looking for its end from each "<" would be quadratic.
        last = source.rfind(">") + 1
        swallowed = False
        for m in chain(_TOKEN.finditer(source, 0, last), _REST.finditer(source, last)):
            if swallowed:
                break
            if m.end() == last and m.re is _TOKEN:
                swallowed = bool(m[1]) and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.IGNORECASE) or m[0].startswith("<!--") and not m[0][4:].endswith("-->")
            name = (m[3] or m[6]) if m.re is _TOKEN else None
            if name is None:
                raw = m[0]
                if m.re is _TOKEN and m[1] or raw.startswith("<") and len(raw) > 1:
                    continue
                add(f"w:{stack[-1][0] if stack else ''}", raw)
                continue
            name = name.lower()
            if m[2] or m[5]:
                if within[name]:
                    while stack[-1][0] != name:
                        close(len(stack) - 1)
                    close(len(stack) - 1)
                add(f"/{name}", None)
                continue
            if name in _PARAGRAPH_END and stack:
                at = max(stack[-1][3:]) if name == "li" else stack[-1][3]
                if at >= 0:
                    close(at)
            if name == "body" and within["head"]:
                close(next(i for i, s in enumerate(stack) if s[0] == "head"))
            attributes = m[4] or m[7] or ""
            skip = bool(stack) and stack[-1][2] or _outside(name, attributes) or name == "header" and not (within["article"] or within["main"])
            if name in VOID or attributes.endswith("/"):
                add(name, None)
                continue
            add(name, None)
            here = len(stack)
            above = (-1, here) if name == "li" else (-1, -1) if name in _CONTAINERS else stack[-1][3:] if stack else (-1, -1)
            stack.append((name, len(self.elements), skip, *((here, above[1]) if name == "p" else above)))
            within[name] += 1
            self.elements.append([name, len(self.kinds), None])
            self.skips[-1] = skip
        close(0)

    def words(self) -> np.ndarray:
        return np.array([0 if t is None else len(t.split()) for t in self.texts], dtype=np.int64)

    def article(self) -> tuple[int, int] | None:
        """Token range of the only ``article``, or else of the only ``main``."""
        for name in ("article", "main"):
            found = [e for e in self.elements if e[0] == name]
            if len(found) == 1:
                return found[0][1], found[0][2]
        return None

    def blocks(self, lo: int, hi: int) -> list[str]:
        out, part = [], []
        for kind, text, skip in zip(self.kinds[lo:hi], self.texts[lo:hi], self.skips[lo:hi], strict=True):
            if text is None:
                if kind.lstrip("/") in BLOCK and part:
                    out.append("".join(part))
                    part = []
            elif not skip:
                part.append(entities.unescape(text))
        out.append("".join(part))
        return [b for b in (" ".join(b.split()) for b in out) if b]


def counts(source: str) -> tuple[Counter, Counter] | None:
    """Tokens by class inside and outside the article of a labelled page."""
    page = Page(source)
    span = page.article()
    if span is None:
        return None
    inside, outside = Counter(), Counter()
    for i, (kind, text, n) in enumerate(zip(page.kinds, page.texts, page.words(), strict=True)):
        (inside if span[0] <= i < span[1] and not page.skips[i] else outside)[kind] += 1 if text is None else int(n)
    return inside, outside


def weights(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weight by token class: log-odds of standing inside, positive for words and negative for tags."""
    out = {}
    for kind, inside, outside in rows:
        odds = float(np.log((inside + 0.5) / (outside + 0.5)))
        out[kind] = min(max(odds, 0.02), 2.0) if kind.startswith("w:") else max(min(odds, -0.1), -8.0)
    return out


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """[lo, hi) of the contiguous run with the highest sum; the first of equals; empty if nothing is positive."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total)
    hi = int(np.argmax(total - low))
    if total[hi] <= low[hi]:
        return 0, 0
    return int(np.flatnonzero(total[: hi + 1] == low[hi])[-1]), hi


def _unseen(kind: str, word: bool) -> float:
    """Weight of a class that no labelled page shows."""
    name = kind.lstrip("/")
    return 1.0 if word else -4.0 if name in OUTSIDE or name == "header" else -1.0 if name in _CONTAINERS else -0.2


def extract(source: str | None, model: dict[str, float]) -> str:
    if not source:
        return ""
    page = Page(source)
    words = page.words()
    if not words.any():
        return ""
    per = np.array([model.get(k, _unseen(k, t is not None)) for k, t in zip(page.kinds, page.texts, strict=True)])
    lo, hi = best_run(np.where([t is not None for t in page.texts], per * words, per))
    clean = np.concatenate([[0], np.cumsum(np.where(page.skips, 0, words))])
    mine = clean[hi] - clean[lo]
    best, at = 0.0, (lo, hi)
    for _, a, b in page.elements:
        both = clean[max(min(b, hi), max(a, lo))] - clean[max(a, lo)]
        agree = 2 * both / (mine + clean[b] - clean[a]) if both else 0.0
        if agree > best or agree == best and agree and b - a < at[1] - at[0]:
            best, at = agree, (a, b)
    if best < _AGREES:
        at = (lo, hi)
    return "\n".join(page.blocks(*at))


def fit(pages: DataFrame, max_pages: int) -> dict[str, float]:
    """Weights from about ``max_pages`` pages; one row per token class of these comes to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for frame in frames:
            for source in frame["html"]:
                if got := counts(source):
                    inside.update(got[0])
                    outside.update(got[1])
        kinds = sorted(inside.keys() | outside.keys())
        if kinds:
            yield pd.DataFrame({"kind": kinds, "inside": [inside[k] for k in kinds], "outside": [outside[k] for k in kinds]})

    n = pages.count()
    some = pages.where("html is not null").where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_pages / max(n, 1))))
    got = some.mapInPandas(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside"), F.sum("outside"))
    return weights([tuple(r) for r in got.collect()])


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 1000) -> DataFrame:
    """page_id, text."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(fit(own, max_pages))

    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([extract(s, model.value) for s in sources], dtype=object)

    return own.select("page_id", F.pandas_udf(run, "string")("html").alias("text"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    own = pages.select(F.struct("page_id", "url").alias("page_id"), "html")
    got = main_text(own)
    return got.select("page_id.page_id", "page_id.url", "text", F.char_length("text").cast("long").alias("n_chars"))
