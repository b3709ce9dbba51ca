"""Crawl of a stored site: links read from the pages, resolved, filtered by prefix and by robots lines, and followed level by level.

Each level joins the pages of the level before with their links, keeps the first place at which a page is met, and leaves out what was met earlier by an
anti-join. A page's place is by its level, then by the place of the page that names it first and where it stands there, as a queue would give
it; places inside a level come from ranges, so no task orders all of it. Robots rules are met by their longest prefix through one equality join
for each length of a rule.

A page without html has no links; a link to itself, to nothing stored, to another host, a fragment or a mail address is not followed; of pages stored twice under
one path the least page_id counts; a missing index gives no pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table
from corpusflow.plans.durable import empty, with_places, written

# Limits of a crawl.
MAX_DEPTH = 5
MAX_PAGES = 500


def rules(robots: DataFrame) -> DataFrame:
    """prefix and allow of the lines of robots(content): Allow and Disallow with a path; `Disallow: /` alone is no rule."""
    line = F.explode(F.split("content", r"\r?\n")).alias("line")
    parts = robots.select(line).select(F.lower(F.regexp_extract("line", r"^\s*([A-Za-z]+)\s*:", 1)).alias("key"), F.regexp_extract("line", r"^\s*[A-Za-z]+\s*:\s*([^\s#]*)", 1).alias("prefix"))
    return parts.where("key IN ('allow', 'disallow') AND prefix <> '' AND prefix <> '/'").select("prefix", (F.col("key") == "allow").alias("allow")).distinct()


def judged(paths: DataFrame, robots: DataFrame) -> DataFrame:
    """paths(path) with allowed and rule, the longest prefix that a line has for it; of equal lines Allow holds."""
    known = rules(robots)
    sizes = known.agg(F.collect_set(F.length("prefix")).alias("sizes"))  # as many as there are lengths of rules
    tried = paths.select("path").distinct().crossJoin(F.broadcast(sizes)).select("path", F.explode_outer("sizes").alias("n")).select("path", F.expr("substr(path, 1, n)").alias("prefix"))
    best = tried.join(known, "prefix").groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("r"))
    return paths.join(best, "path", "left").select(paths["*"], F.coalesce("r.allow", F.lit(True)).alias("allowed"), F.col("r.prefix").alias("rule"))


def page_links(pages: DataFrame, base: str) -> DataFrame:
    """path, pos and target of the links of pages(path, html) that stay on the site; base is scheme, host and folder."""
    host = F.regexp_extract(F.lit(base), r"^(https?://[^/]+)", 1)
    rows = pages.select("path", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    rows = rows.where(F.col("href") != "").where(~F.col("href").rlike(r"^(https?://|#|mailto:)"))
    absolute = F.when(F.startswith("href", F.lit("/")), F.concat(host, "href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "href"))
    rows = rows.withColumn("absolute", F.regexp_replace(absolute, "[?#].*$", "")).where(F.startswith("absolute", F.lit(base.rstrip("/"))))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), F.regexp_replace("absolute", r"^https?://[^/]+", "").alias("target"))


def crawl(pages: DataFrame, robots: DataFrame, base: str, index: str, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES) -> DataFrame:
    """path, page_id, depth and place, from 1, of the pages met from the index, at most max_depth links away and max_pages in all."""
    stored = written(pages.groupBy("path").agg(F.min_by("page_id", "page_id").alias("page_id"), F.min_by("html", "page_id").alias("html")), "stored")
    open_ = judged(stored.select("path", "page_id"), robots).where("allowed").select("path", "page_id")
    links = page_links(stored, base).groupBy("path", "target").agg(F.min("pos").alias("pos"))
    links = written(links.join(open_.select(F.col("path").alias("target"), "page_id"), "target"), "links")
    front = written(open_.where(F.col("path") == index).select("path", "page_id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place")), "front")
    met = [front]
    n = front.count()
    for depth in range(1, max_depth + 1):
        if not n or n >= max_pages:
            break
        named = front.select("path", "place").join(links, "path").groupBy("target").agg(F.min(F.struct("place", "pos")).alias("at"), F.first("page_id").alias("page_id"))
        seen = reduce(DataFrame.union, [m.select(F.col("path").alias("target")) for m in met])
        new = with_places(named.join(seen, "target", "left_anti"), F.col("at.place"), F.col("at.pos"), place="k")
        front = written(new.where(F.col("k") <= max_pages - n).select(F.col("target").alias("path"), "page_id", F.lit(depth).alias("depth"), (F.col("k") + n).cast("long").alias("place")), "front")
        if empty(front):
            break
        met.append(front)
        n += front.count()
    return reduce(DataFrame.union, met).select("path", "page_id", F.col("depth").cast("long").alias("depth"), "place")


BASE = "https://docs.example.org/docs"
# A site from the pages: a page lies under the first two letters of its first link, other links lead to the pages of theirs, as paths, names in the folder or addresses.
_HTML = r"""$replace_all($replace_all($replace_all($replace_all(lower(html), r'href="/([^"]{1,2})[^"]*"', 'href="/@@1"'), r'href="/([a-k])', 'href="@@1'), r'href="/([s])', 'href="https://docs.example.org/docs/@@1'), r'href="/', 'href="/docs/')"""
table("site_pages", f"""SELECT page_id, '/docs/' || lower(substr($extract(html, r'href="/([^"]*)"', 1), 1, 2)) AS path, {_HTML} AS html FROM {{pages}} WHERE $matches(html, r'href="/[^"]')""")
table("site_robots", "SELECT 'User-agent: *' || $chr(10) || 'Disallow: /docs/la' || $chr(10) || 'allow: /docs/las # not these' || $chr(10) || ' DISALLOW:/docs/un' || $chr(10) || 'Disallow: /' || $chr(10) || 'Disallow:' AS content")
_RULES = r"""
rules AS (SELECT DISTINCT regexp_extract(l, '^\s*[A-Za-z]+\s*:\s*([^\s#]*)', 1) AS prefix, lower(regexp_extract(l, '^\s*([A-Za-z]+)\s*:', 1)) = 'allow' AS allow FROM (SELECT unnest(string_split(content, chr(10))) AS l FROM {robots}) WHERE lower(regexp_extract(l, '^\s*([A-Za-z]+)\s*:', 1)) IN ('allow', 'disallow') AND regexp_extract(l, '^\s*[A-Za-z]+\s*:\s*([^\s#]*)', 1) NOT IN ('', '/')),
stored AS (SELECT path, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM {pages} GROUP BY path),
verdicts AS (SELECT s.path, s.page_id, coalesce(arg_max(allow, (length(prefix), allow)), true) AS allowed, arg_max(prefix, (length(prefix), allow)) AS rule FROM stored s LEFT JOIN rules r ON starts_with(s.path, r.prefix) GROUP BY s.path, s.page_id)"""


def _crawl_oracle() -> str:
    steps = ["f0 AS (SELECT path, page_id, 0 AS depth, 1 AS place FROM verdicts WHERE allowed AND path = (SELECT path FROM {pages} ORDER BY page_id LIMIT 1))"]
    for d in range(1, MAX_DEPTH + 1):
        seen = " UNION ALL ".join(f"SELECT path FROM f{i}" for i in range(d))
        count = " + ".join(f"(SELECT count(*) FROM f{i})" for i in range(d))
        steps.append(f"f{d} AS (SELECT target AS path, page_id, {d} AS depth, row_number() OVER (ORDER BY spot) + {count} AS place FROM (SELECT l.target, v.page_id, min((place, pos)) AS spot FROM f{d - 1} f JOIN links l ON l.path = f.path JOIN verdicts v ON v.path = l.target AND v.allowed WHERE l.target NOT IN ({seen}) GROUP BY ALL) QUALIFY place <= {MAX_PAGES})")
    return (
        "WITH "
        + _RULES
        + r""",
hrefs AS (SELECT path, i AS pos, h[i] AS href FROM (SELECT path, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT path, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1) AS h FROM stored))),
links AS (SELECT path, pos, regexp_replace(regexp_replace(CASE WHEN href[1] = '/' THEN 'https://docs.example.org' || href ELSE 'https://docs.example.org/docs/' || href END, '[?#].*$', ''), '^https?://[^/]+', '') AS target FROM hrefs WHERE href <> '' AND NOT regexp_matches(href, '^(https?://|#|mailto:)')),
"""
        + ",\n".join(steps)
        + "\n"
        + " UNION ALL ".join(f"SELECT path, page_id, depth::BIGINT AS depth, place FROM f{d}" for d in range(MAX_DEPTH + 1))
    )


@program("src_html_site", _crawl_oracle(), pages="site_pages", robots="site_robots")
def src_html_site(pages, robots):
    """Pages of a site in the order of a crawl from its index, the page of the least id."""
    index = pages.agg(F.min_by("path", "page_id")).first()[0]
    return crawl(pages, robots, BASE, index)


@program("src_robots", "WITH " + _RULES + " SELECT path, page_id, allowed, rule FROM verdicts", pages="site_pages", robots="site_robots")
def src_robots(pages, robots):
    """Which pages the robots lines allow, and by which line."""
    stored = pages.groupBy("path").agg(F.min("page_id").alias("page_id"))
    return judged(stored, robots).select("path", "page_id", "allowed", "rule")
