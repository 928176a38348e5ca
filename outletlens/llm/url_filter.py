"""URL filter by rules and a path-template tree, in DataFrame functions only.

Fixed rules decide first and are also the labels. For the other pages each host's
paths form a tree: a segment that fewer than ``1 / LITERALS`` of the host's pages have
at its depth, or that holds a digit, becomes a wildcard, so a host has a bounded number
of templates however many pages it has. Templates that differ in their last literal
alone are siblings; those whose share of blocked pages does not differ significantly
from the other siblings' are merged. A template is rejected if the smoothed purity
(blocked + 1) / (labelled + ``PRIOR``) of its merged branch reaches ``REJECT``.

Every grouping is a count with map-side combine, and pages meet templates in joins
that the engine can split, so one host may hold any share of the rows.

Defined cases: a null url, or one without ``://``, has empty host and path, matches no
rule and is judged as the template of the empty host; repeated rows count as often as
they occur; an empty table gives no rows; columns other than page_id and url are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: verdict, host, path; the longest that fits decides, then the alphabetically first.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LITERALS = 100
PRIOR = 5
REJECT = 50
#: Square of the normal deviate below which two shares count as equal.
SIMILAR = 4.0


def _parts(url: Column):
    """Host (A-Z lower-cased) and path of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _by_rule(rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits the columns host and path, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((F.col("host") == r[1]) | F.endswith(F.col("host"), F.lit("." + r[1]))) & F.startswith(F.col("path"), F.lit(r[2]))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template, blocked, labelled (of its merged branch)."""
    host, path = _parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", _by_rule(rules, lambda r: r[1] + r[2]).alias("rule"), _by_rule(rules, lambda r: r[0]).alias("ruled"))

    # segments that stay literal: frequent at their depth of the host, and without digits
    # (those are counted as one, so numbered pages do not make rows here)
    seen = (rows.select("host", F.posexplode(_segments(F.col("path"))).alias("depth", "segment"))
            .withColumn("segment", F.when(~F.col("segment").rlike("[0-9]"), F.col("segment")))
            .groupBy("host", "depth", "segment").agg(F.count("*").alias("n")))
    total = seen.groupBy("host", "depth").agg(F.sum("n").alias("of"))
    literal = (seen.where("segment is not null and n > 1").join(total, ["host", "depth"])
               .where(F.col("n") * LITERALS >= F.col("of"))
               .groupBy("host").agg(F.collect_list(F.concat_ws("/", F.col("depth").cast("string"), "segment")).alias("literals")))
    known = F.coalesce(F.col("literals"), F.array().cast("array<string>"))
    segments = F.transform(_segments(F.col("path")), lambda s, i: F.when(
        F.array_contains(known, F.concat_ws("/", i.cast("string"), s)), s).otherwise("*"))
    rows = rows.join(literal, "host", "left").withColumn("template", F.concat(F.lit("/"), F.array_join(segments, "/"))).drop("literals")

    trees = rows.groupBy("host", "template").agg(
        F.count("*").alias("n"), F.count("ruled").alias("known"), F.count_if(F.col("ruled") == "block").alias("bad"))
    # siblings differ in their last literal alone
    trees = trees.withColumn("branch", F.regexp_replace("template", r"/[^/*]+((/\*)*)\z", "/*$1"))
    around = Window.partitionBy("host", "branch")
    trees = trees.withColumn("all_n", F.sum("n").over(around)).withColumn("all_bad", F.sum("bad").over(around))

    def d(c):
        return F.col(c).cast("double")
    gap = d("bad") * (d("all_n") - d("n")) - (d("all_bad") - d("bad")) * d("n")
    alike = gap * gap * d("all_n") <= SIMILAR * d("n") * (d("all_n") - d("n")) * d("all_bad") * (d("all_n") - d("all_bad"))
    trees = trees.withColumn("alike", alike)
    merged = Window.partitionBy("host", "branch", "alike")
    trees = trees.select(
        F.col("host").alias("_host"), F.col("template").alias("_template"),
        F.when(F.col("alike"), F.sum("bad").over(merged)).otherwise(F.col("bad")).alias("blocked"),
        F.when(F.col("alike"), F.sum("known").over(merged)).otherwise(F.col("known")).alias("labelled"))
    out = rows.join(trees, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")))
    method = F.when(100 * (F.col("blocked") + 1) >= REJECT * (F.col("labelled") + PRIOR), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "blocked", "labelled")


SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (
    SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(v, h, p)),
fit AS (
    SELECT host AS fh, path AS fp, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS ruled
    FROM (SELECT DISTINCT host, path FROM parts), rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
rows_ AS (
    SELECT page_id, host, path, rule, ruled, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs
    FROM parts LEFT JOIN fit ON host = fh AND path = fp),
seen AS (
    SELECT host, depth, segs[(depth + 1)::BIGINT] AS segment, count(*) AS n
    FROM (SELECT host, segs, unnest(range(len(segs))) AS depth FROM rows_) GROUP BY 1, 2, 3),
literal AS (
    SELECT host AS lh, list(depth || '/' || segment) AS literals
    FROM (SELECT *, sum(n) OVER (PARTITION BY host, depth) AS total FROM seen)
    WHERE n * 100 >= total AND n > 1 AND NOT regexp_matches(segment, '[0-9]') GROUP BY 1),
templated AS (
    SELECT page_id, host, path, rule, ruled, '/' || array_to_string(list_transform(segs, lambda s, i:
        CASE WHEN list_contains(coalesce(literals, []::VARCHAR[]), (i - 1) || '/' || s) THEN s ELSE '*' END), '/') AS template
    FROM rows_ LEFT JOIN literal ON host = lh),
trees AS (
    SELECT host, template, regexp_replace(template, '/[^/*]+((/\*)*)\z', '/*\1') AS branch,
        count(*)::DOUBLE AS n, count(ruled) AS known, count(*) FILTER (ruled = 'block') AS bad
    FROM templated GROUP BY 1, 2),
summed AS (
    SELECT *, sum(n) OVER (PARTITION BY host, branch) AS all_n, sum(bad) OVER (PARTITION BY host, branch)::DOUBLE AS all_bad FROM trees),
tested AS (
    SELECT *, (bad * (all_n - n) - (all_bad - bad) * n) * (bad * (all_n - n) - (all_bad - bad) * n) * all_n
        <= 4.0::DOUBLE * n * (all_n - n) * all_bad * (all_n - all_bad) AS alike FROM summed),
merged AS (
    SELECT host AS mh, template AS mt, CASE WHEN alike THEN sum(bad) OVER w ELSE bad END::BIGINT AS blocked,
        CASE WHEN alike THEN sum(known) OVER w ELSE known END::BIGINT AS labelled
    FROM tested WINDOW w AS (PARTITION BY host, branch, alike))
SELECT page_id, host, path, rule,
    coalesce(ruled, CASE WHEN 100 * (blocked + 1) >= 50 * (labelled + 5) THEN 'block' ELSE 'allow' END) AS verdict, template, blocked, labelled
FROM templated JOIN merged ON host = mh AND template = mt
"""
