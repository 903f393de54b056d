"""URL filter: rules first, then a path-template tree per host.  DataFrame functions only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: then up to ``?``,
``#`` or the end.  A null url, or one without ``://``, has both empty.  A rule fits its host and all
subdomains if the path starts with the rule's; the longest rule wins, and its verdict is final.

Tree: a path is cut at ``/`` into segments, in which runs of digits become ``#``.  From the root of a host's tree
down, a node of ``EVIDENCE`` urls or more is looked at, labelled or not.  Where more than ``VARIABLE`` of its
urls have a segment of their own, the segment is variable and its branches become ``*``.  Otherwise branches
are merged into ``~`` that are statistically alike: the segments one further down are spread as in all of the
node's branches, by the chi-square statistic within ``SIGMAS`` standard deviations, and the share of blocked
urls, if any are labelled, does not differ from the node's by more than as many.  Other branches stay apart, as
do all of smaller nodes.

What rules decide is the labelled evidence.  A url without a rule is blocked if its template has labelled urls
and their blocked share, smoothed by ``PRIOR`` urls at the share of all templates with the same parent, which is
itself smoothed towards that of all labelled urls, is at least ``PURITY``; else it is allowed.

The tree is built from counts of distinct templates, pre-aggregated, so a host with a third of all pages is
a few rows.  Repeated rows count one by one and are judged alike; an empty table gives no rows; other columns
are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import UPPER, Scratch, table

#: (verdict, host, path); a curated list, inlined into the expression.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
EVIDENCE = 8
VARIABLE = 0.5
SIGMAS = 2.0
PRIOR = 2.0
PURITY = 0.9


def host_and_path(url: str) -> tuple[Column, Column]:
    part = [F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(part[0], UPPER, UPPER.lower()), part[1]


def matched(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits columns host and path; null if none does."""
    host, path = F.col("host"), F.col("path")
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*fits)


def _segments() -> Column:
    return F.transform(F.expr("filter(split(path, '/'), s -> s <> '')"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def _level(scratch: Scratch, live: DataFrame, d: int) -> DataFrame:
    """Adds ``name`` to ``live(host, node, segments, n, known, bad)``: that of segment ``d`` below ``node``; null below small nodes."""
    at = ["host", "node"]
    own = live.withColumn("seg", F.col("segments")[d]).withColumn("shape", F.coalesce(F.get("segments", F.lit(d + 1)), F.lit("")))
    cells = scratch.cut(own.groupBy(*at, "seg", "shape").agg(F.sum("n").alias("c"), F.sum("known").alias("k"), F.sum("bad").alias("b")), "cells")
    shapes = cells.groupBy(*at, "shape").agg(F.sum("c").alias("every"))
    kids = cells.join(shapes, [*at, "shape"]).groupBy(*at, "seg").agg(F.sum("c").alias("m"), F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum(F.col("c") * F.col("c") / F.col("every")).alias("q"))
    free = shapes.groupBy(*at).agg((F.count("*") - 1).alias("free"))
    node = kids.groupBy(*at).agg(F.sum("m").alias("total"), F.count("*").alias("kinds"), (F.try_divide(F.sum("b"), F.sum("k"))).alias("common"))
    kids = kids.join(node, at).join(free, at)
    chi = F.round(F.col("total") * F.col("q") / F.col("m") - F.col("m"), 6)
    alike = chi <= F.round(F.col("free") + SIGMAS * F.sqrt(2 * F.col("free")), 6)
    apart = F.round(F.abs(F.col("b") / F.greatest("k", F.lit(1)) - F.col("common")), 6) > F.round(SIGMAS * F.sqrt(F.col("common") * (1 - F.col("common")) / F.greatest("k", F.lit(1))), 6)
    variable = F.col("kinds") > VARIABLE * F.col("total")
    name = F.when(variable, "*").when(alike & ((F.col("k") == 0) | ~apart), "~").otherwise(F.concat(F.lit("="), "seg"))
    kids = kids.select(*at, "seg", F.when(F.col("total") >= EVIDENCE, name).alias("name"))
    return own.drop("shape").join(kids, [*at, "seg"]).drop("seg")


def _templates(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """Adds ``template`` to ``leaves(host, segments, n, known, bad)``.

    One round for each level on which some node has enough urls, however long the longest path is.
    """
    live = leaves.withColumn("node", F.lit(""))
    done, d = live.where("size(segments) = 0").withColumnRenamed("node", "template"), 0
    live = live.where("size(segments) > 0")
    columns = done.columns
    while True:
        step = scratch.cut(_level(scratch, live, d), "level")
        # Below a node with few urls are only nodes with fewer: the rest of the path is its own template.
        rest = F.concat("node", F.lit("/="), F.array_join(F.slice("segments", d + 1, F.size("segments")), "/="))
        node = F.when(F.col("name").isNull(), rest).otherwise(F.concat("node", F.lit("/"), "name"))
        over = F.col("name").isNull() | (F.size("segments") == d + 1)
        done = done.union(step.where(over).withColumn("template", node).select(columns))
        live = step.where(~over).withColumn("node", node).drop("name")
        if live.isEmpty():
            return done
        d += 1


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("m", matched(rules)).select("page_id", "host", "path", "m.rule", F.col("m.verdict").alias("ruled"), _segments().alias("segments"))
    leaves = urls.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("ruled").alias("known"), F.count_if(F.col("ruled") == "block").alias("bad"))
    leaves = scratch.cut(leaves, "leaves")
    rate = leaves.agg(F.try_divide(F.sum("bad"), F.sum("known"))).first()[0] or 0.0
    leaves = scratch.cut(_templates(scratch, leaves), "tree")

    nodes = leaves.groupBy("host", "template").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"))
    nodes = nodes.where("k > 0").withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    family = nodes.groupBy("host", "parent").agg(((F.sum("b") + PRIOR * rate) / (F.sum("k") + PRIOR)).alias("common"))
    purity = F.round((F.col("b") + PRIOR * F.col("common")) / (F.col("k") + PRIOR), 9)
    rejected = nodes.join(family, ["host", "parent"]).where(purity >= PURITY).select("host", "template")
    bad = leaves.join(rejected, ["host", "template"], "left_semi").select("host", "segments", F.lit("block").alias("learned"))
    bad = scratch.cut(bad, "rejected")
    out = urls.join(bad, ["host", "segments"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned", F.lit("allow")).alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_LEVEL = r"""
o{d} AS (SELECT *, seg[{d} + 1] AS s, coalesce(seg[{d} + 2], '') AS shape FROM t{d} WHERE len(seg) > {d} AND NOT over),
c{d} AS (SELECT host, node, s, shape, sum(n) AS c, sum(known) AS k, sum(bad) AS b FROM o{d} GROUP BY ALL),
e{d} AS (SELECT host, node, shape, sum(c) AS every FROM c{d} GROUP BY ALL),
k{d} AS (SELECT host, node, s, sum(c) AS m, sum(k) AS k, sum(b) AS b, sum(c * c / every::DOUBLE) AS q FROM c{d} JOIN e{d} USING (host, node, shape) GROUP BY ALL),
g{d} AS (SELECT host, node, sum(m) AS total, count(*) AS kinds, sum(b)::DOUBLE / nullif(sum(k), 0) AS common FROM k{d} GROUP BY ALL),
f{d} AS (SELECT host, node, count(*) - 1 AS free FROM e{d} GROUP BY ALL),
n{d} AS (SELECT host, node, s, CASE WHEN total < 8 THEN NULL WHEN kinds > 0.5 * total THEN '*'
  WHEN round(total * q / m - m, 6) <= round(free + 2.0 * sqrt(2 * free), 6) AND (k = 0 OR round(abs(b::DOUBLE / k - common), 6) <= round(2.0 * sqrt(common * (1 - common) / k), 6)) THEN '~'
  ELSE '=' || s END AS name FROM k{d} JOIN g{d} USING (host, node) JOIN f{d} USING (host, node)),
t{e} AS (SELECT host, seg, n, known, bad, CASE WHEN name IS NULL THEN node || '/=' || array_to_string(seg[{d} + 1:], '/=') ELSE node || '/' || name END AS node, name IS NULL OR len(seg) = {d} + 1 AS over
  FROM o{d} JOIN n{d} USING (host, node, s)),"""
#: The oracle's tree goes this deep; the longest path of the tables has two segments.
_LEVELS = 4

ORACLE = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS cut FROM parts),
urls AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
    list_transform(cut, lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS seg FROM ruled),
t0 AS (SELECT host, seg, count(*) AS n, count(ruled) AS known, count(*) FILTER (ruled = 'block') AS bad, '' AS node, len(seg) = 0 AS over FROM urls GROUP BY host, seg),""" + "".join(_LEVEL.format(d=d, e=d + 1) for d in range(_LEVELS)) + f"""
tree AS ({" UNION ALL ".join(f"SELECT host, seg, known, bad, node AS template FROM t{d} WHERE over" for d in range(_LEVELS + 1))}),
nodes AS (SELECT host, template, sum(known) AS k, sum(bad) AS b, regexp_replace(template, '/[^/]*$', '') AS parent FROM tree GROUP BY host, template HAVING sum(known) > 0),
rate AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(known), 0), 0) AS r FROM tree),
family AS (SELECT host, parent, (sum(b) + 2.0 * any_value(r)) / (sum(k) + 2.0) AS common FROM nodes, rate GROUP BY host, parent),
rejected AS (SELECT host, template FROM nodes JOIN family USING (host, parent) WHERE round((b + 2.0 * common) / (k + 2.0), 9) >= 0.9),
learned AS (SELECT host, seg FROM tree SEMI JOIN rejected USING (host, template))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN l.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM urls u LEFT JOIN learned l USING (host, seg)
"""
