"""Tables from words: rows and columns as intervals, cells by where words fall, header rows, and cells that span several rows or columns.

Words meet the table regions of their page that they touch. Of a region's word centres, in order, one that lies more than ROW_GAP beyond the first of its row
begins another row, and likewise for columns inside each row: a fold over the sorted distinct positions whose state holds the beginnings so
far, so that a word's row and column are counts of beginnings at or before it. All else is grouping by region.

A region with fewer than four words or two rows is no table; null positions and texts are no words; a region without words gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table

# Distances and factors.
ROW_GAP, COLUMN_GAP = 4.0, 6.0
HEADER_ROWS = 3
HEADER_SIZE = 1.1
BOLD = "Bold|Black|Heavy|Demi"
SPAN = 4.0
FEW_ROWS = 3
SURE, UNSURE = 0.92, 0.60
REGION = ("page", "region_id")


def _beginnings(values: str, gap: float) -> str:
    return f"aggregate(slice({values}, 2, size({values})), array({values}[0]), (s, v) -> if(v - element_at(s, -1) > {gap}D, concat(s, array(v)), s))"


def cells(words: DataFrame, regions: DataFrame) -> DataFrame:
    """page, region_id, r, c from 0, header, text and the extent of each cell; words(page, word_id, x, y, w, h, font_size, font_name, text), regions(page, region_id, x, y, w, h). y rises upward.

    Words are dealt once, by page: groups of a page are made where it is, and what holds of a region comes to its words in their group, not by a join."""
    sizes = F.count("*").over(Window.partitionBy("page", "font_size"))
    body = F.min_by(F.when(F.col("font_size") > 0, F.col("font_size")), F.when(F.col("font_size") > 0, F.struct(-F.col("_n"), "font_size"))).over(Window.partitionBy("page"))
    words = words.withColumn("_n", sizes).withColumn("body", body)
    w = words.where("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AND text IS NOT NULL").alias("w")
    r = regions.alias("r")
    touch = (F.col("w.page") == F.col("r.page")) & (F.least(F.expr("r.x + r.w"), F.expr("w.x + w.w")) >= F.greatest("r.x", "w.x")) & (F.least(F.expr("r.y + r.h"), F.expr("w.y + w.h")) >= F.greatest("r.y", "w.y"))
    strong = F.coalesce(F.col("w.font_name"), F.lit("")).rlike(BOLD) | F.coalesce(F.col("w.font_size").cast("double") >= HEADER_SIZE * F.coalesce("w.body", F.lit(12.0)), F.lit(False))
    found = w.join(r, touch).select("r.page", "r.region_id", "w.word_id", *(F.col(f"w.{c}").cast("double").alias(c) for c in ("x", "y", "w", "h")), strong.alias("strong"), F.trim("w.text").alias("text")).withColumn("mid", F.col("y") + F.col("h") / 2)
    held = F.collect_list(F.struct("word_id", "x", "y", "w", "h", "strong", "text", "mid")).alias("held")
    rows = found.groupBy(*REGION).agg(held, F.sort_array(F.collect_set("mid")).alias("ys")).where("size(held) >= 4").withColumn("starts", F.expr(_beginnings("ys", ROW_GAP))).where("size(starts) >= 2")
    placed = rows.select(*REGION, "starts", F.inline("held")).withColumn("r", F.expr("size(starts) - size(filter(starts, s -> s <= mid))")).drop("starts")
    columns = placed.groupBy(*REGION, "r").agg(held, F.sort_array(F.collect_set("x")).alias("xs")).withColumn("starts", F.expr(_beginnings("xs", COLUMN_GAP)))
    placed = columns.select(*REGION, "r", "starts", F.inline("held")).withColumn("c", F.expr("size(filter(starts, s -> s <= x)) - 1")).drop("starts")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_id", "text"))), lambda t: t.text), " ")
    grid = placed.groupBy(*REGION, "r", "c").agg(F.trim(told).alias("text"), F.max("strong").alias("strong"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"), F.avg("w").alias("width"), F.sum("h").alias("heights"), F.count("*").alias("n"), F.collect_list(F.col("x") + F.col("w") / 2).alias("centres"))
    # the head is the unbroken run of strong rows at the top
    line = Window.partitionBy(*REGION, "r")
    plain = F.min(F.when(~F.col("_any"), F.col("r"))).over(Window.partitionBy(*REGION))
    return grid.withColumn("_any", F.max("strong").over(line)).withColumn("header", (F.col("r") < F.coalesce(plain, F.lit(HEADER_ROWS))) & (F.col("r") < HEADER_ROWS)).drop("_any", "strong")


def tables(words: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for each row of a table: row_no, header, row_text with its cells between bars, and rows, cols, confidence of the table."""
    grid = cells(words, regions)
    per = Window.partitionBy(*REGION)
    rows = grid.groupBy(*REGION, "r", "header").agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("cells"))
    rows = rows.withColumn("cols", F.max(F.size("cells")).over(per)).withColumn("heads", F.count_if("header").over(per)).withColumn("rows", (F.count("*").over(per) - F.col("heads")).cast("long"))
    text = F.concat(F.array_join(F.transform("cells", lambda x: x.text), "|"), F.repeat(F.lit("|"), F.col("cols") - F.size("cells")))
    sure = F.when((F.col("rows") < FEW_ROWS) & (F.col("heads") == 0), UNSURE).otherwise(SURE)
    return rows.select(*REGION, F.col("r").cast("long").alias("row_no"), "header", text.alias("row_text"), "rows", F.col("cols").cast("long").alias("cols"), sure.alias("confidence"))


def merged_cells(words: DataFrame, regions: DataFrame) -> DataFrame:
    """page, region_id, r, c, rowspan, colspan and value of cells wider than SPAN columns with nothing else of their row in them, or higher than SPAN rows."""
    grid = cells(words, regions)
    per, line, column = Window.partitionBy(*REGION), Window.partitionBy(*REGION, "r"), Window.partitionBy(*REGION, "c")
    # a width for each column, its first row's, and a height for each row, its first column's
    df = grid.withColumn("_width", F.max("width").over(column)).withColumn("_top", F.col("r") == F.min("r").over(column))
    df = df.withColumn("_height", F.sum("heights").over(line) / F.sum("n").over(line)).withColumn("_left", F.col("c") == F.min("c").over(line))
    df = df.withColumn("all", F.flatten(F.collect_list("centres").over(line))).withColumn("inside", F.expr("size(filter(all, m -> x0 < m AND m < x1)) - size(filter(centres, m -> x0 < m AND m < x1))")).drop("all", "centres")
    df = df.withColumn("ws", F.sort_array(F.collect_list(F.when(F.col("_top") & (F.col("_width") > 0), F.col("_width"))).over(per))).withColumn("row_h", F.avg(F.when(F.col("_left"), F.col("_height"))).over(per))
    df = df.withColumn("col_w", F.when(F.size("ws") > 0, F.least(F.expr("get(ws, cast(size(ws) div 2 AS INT))"), F.expr("aggregate(ws, 0D, (s, x) -> s + x) / size(ws)") * 1.2)).otherwise(1.0)).drop("ws")
    df = df.withColumn("wide", (F.col("x1") - F.col("x0") > SPAN * F.col("col_w")) & (F.col("inside") == 0)).withColumn("high", F.col("y1") - F.col("y0") > SPAN * F.col("row_h")).where("text <> '' AND (wide OR high)")
    span = lambda size, unit: F.greatest(F.lit(1), F.bround(size / F.greatest(unit, F.lit(1.0)), 0)).cast("long")
    return df.select(*REGION, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.when(F.col("high"), span(F.col("y1") - F.col("y0"), F.col("row_h"))).otherwise(1).alias("rowspan"), F.when(F.col("wide"), span(F.col("x1") - F.col("x0"), F.col("col_w"))).otherwise(1).alias("colspan"), F.col("text").alias("value"))


# A table for each order: a head, a row for each of its lines, now and then a title over all columns, a cell of several rows, two words in a cell.
_word = lambda k, x, dy, w, h, text, font, size, where: f"SELECT l_orderkey AS page, n * 16 + {k} AS word_id, {x} AS x, 900 - n * 20 + {dy} AS y, {w} AS w, {h} AS h, {size} AS font_size, '{font}' AS font_name, {text} AS text FROM l WHERE {where}"
_DRAWN = (
    (0, "0 + l_partkey % 5", "l_partkey % 4", 30, 10, "'p' || $text(l_partkey)", "Serif", "10.0E0", "true"),
    (1, "100", "0", 30, 10, "$text($long(l_quantity))", "Serif", "10.0E0", "l_partkey % 6 <> 0"),
    (2, "200", "1", 25, "CASE WHEN l_orderkey % 7 = 0 AND n = 1 THEN 60 ELSE 10 END", "l_returnflag", "Serif", "10.0E0", "true"),
    (3, "204", "1", 20, 10, "'x'", "Serif", "10.0E0", "l_partkey % 3 = 0"),
    (4, "0", "20", 20, 10, "'Part'", "Serif-Bold", "10.0E0", "n = 1 AND l_orderkey % 4 <> 0"),
    (5, "100", "20", 20, 10, "'Count'", "Serif", "12.0E0", "n = 1 AND l_orderkey % 4 <> 0"),
    (6, "200", "20", 20, 10, "'Flag'", "Serif", "10.0E0", "n = 1"),
    (7, "10", "40", 260, 10, "'Order ' || $text(l_orderkey)", "Serif", "10.0E0", "n = 1 AND l_orderkey % 5 = 0"),
)
_LINES = "WITH l AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, $long(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS n FROM {lineitem})\n"
# Spark makes all words of a line at once, so that lines are dealt once and not for each kind of word.
_struct = lambda k, x, dy, w, h, text, font, size, where: f"struct({where} AS drawn, n * 16 + {k} AS word_id, cast({x} AS BIGINT) AS x, cast(900 - n * 20 + {dy} AS BIGINT) AS y, {w} AS w, {h} AS h, {size} AS font_size, '{font}' AS font_name, {text} AS text)"
table(
    "sheet_words",
    _LINES + f"SELECT page, word_id, x, y, w, h, font_size, font_name, text FROM (SELECT l_orderkey AS page, inline(array({', '.join(_struct(*d) for d in _DRAWN)})) FROM l) WHERE drawn",
    _LINES + "\nUNION ALL ".join(_word(*d) for d in _DRAWN),
)
table("sheet_regions", "SELECT DISTINCT l_orderkey AS page, $long(1) AS region_id, 0 AS x, 700 AS y, 400 AS w, 300 AS h FROM {lineitem} UNION ALL SELECT DISTINCT l_orderkey, $long(2), 500, 0, 10, 10 FROM {lineitem} WHERE l_orderkey % 3 = 0")


def _oracle(end: str) -> str:
    starts = lambda vs, gap: f"list_reduce(list_transform({vs}, lambda v: [v]), lambda a, b: CASE WHEN b[1] - a[-1] > {gap} THEN list_append(a, b[1]) ELSE a END)"
    return (
        f"""
WITH body AS (SELECT page, arg_min(font_size, (-n, font_size)) AS body FROM (SELECT page, font_size, count(*) AS n FROM {{words}} WHERE font_size > 0 GROUP BY ALL) GROUP BY page),
found AS (SELECT r.page, r.region_id, w.word_id, w.x::DOUBLE AS x, w.y::DOUBLE AS y, w.w::DOUBLE AS w, w.h::DOUBLE AS h, trim(w.text) AS text, w.y + w.h / 2 AS mid, coalesce(regexp_matches(w.font_name, '{BOLD}'), false) OR coalesce(w.font_size >= {HEADER_SIZE} * coalesce(b.body, 12), false) AS strong
  FROM {{words}} w JOIN {{regions}} r ON w.page = r.page AND w.x <= r.x + r.w AND r.x <= w.x + w.w AND w.y <= r.y + r.h AND r.y <= w.y + w.h LEFT JOIN body b ON b.page = w.page),
rs AS (SELECT page, region_id, {starts('list_sort(list(DISTINCT mid))', ROW_GAP)} AS starts FROM found GROUP BY ALL HAVING count(*) >= 4),
p1 AS (SELECT f.*, len(starts) - len(list_filter(starts, lambda s: s <= mid)) AS r FROM found f JOIN rs USING (page, region_id) WHERE len(starts) >= 2),
cs AS (SELECT page, region_id, r, {starts('list_sort(list(DISTINCT x))', COLUMN_GAP)} AS starts FROM p1 GROUP BY ALL),
p2 AS (SELECT p.*, len(list_filter(starts, lambda s: s <= x)) - 1 AS c FROM p1 p JOIN cs USING (page, region_id, r)),
top AS (SELECT page, region_id, coalesce(min(r) FILTER (WHERE NOT strong), {HEADER_ROWS}) AS plain FROM (SELECT page, region_id, r, bool_or(strong) AS strong FROM p2 GROUP BY ALL) GROUP BY ALL),
cell AS (SELECT page, region_id, r, c, trim(string_agg(text, ' ' ORDER BY x, word_id)) AS text, min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + h) AS y1, avg(w) AS width FROM p2 GROUP BY ALL),
"""
        + end
    )


@program(
    "tab_extract",
    _oracle(f"""
rows AS (SELECT page, region_id, r, string_agg(text, '|' ORDER BY c) AS row_text, count(*) AS n FROM cell GROUP BY ALL),
sized AS (SELECT rows.*, max(n) OVER (PARTITION BY page, region_id) AS cols, r < plain AND r < {HEADER_ROWS} AS header FROM rows JOIN top USING (page, region_id)),
told AS (SELECT *, count_if(header) OVER (PARTITION BY page, region_id) AS heads, count(*) OVER (PARTITION BY page, region_id) AS lines FROM sized)
SELECT page, region_id, r AS row_no, header, row_text || repeat('|', cols - n) AS row_text, (lines - heads)::BIGINT AS rows, cols, CASE WHEN lines - heads < {FEW_ROWS} AND heads = 0 THEN {UNSURE}::DOUBLE ELSE {SURE}::DOUBLE END AS confidence FROM told
"""),
    words="sheet_words",
    regions="sheet_regions",
)
def tab_extract(words, regions):
    """Rows of the tables of each page, with header rows and confidence."""
    return tables(words, regions)


@program(
    "tab_merged_cells",
    _oracle(f"""
ws AS (SELECT page, region_id, list_sort(list(width)) AS ws FROM (SELECT page, region_id, c, max(width) AS width FROM cell GROUP BY ALL) WHERE width > 0 GROUP BY ALL),
hs AS (SELECT page, region_id, avg(h) AS row_h FROM (SELECT page, region_id, r, avg(h) AS h FROM p2 GROUP BY ALL) GROUP BY ALL),
sized AS (SELECT cell.*, least(ws[len(ws) // 2 + 1], list_sum(ws) / len(ws) * 1.2) AS col_w, row_h, NOT EXISTS (SELECT 1 FROM p2 WHERE p2.page = cell.page AND p2.region_id = cell.region_id AND p2.r = cell.r AND p2.c <> cell.c AND p2.x + p2.w / 2 > x0 AND p2.x + p2.w / 2 < x1) AS free FROM cell JOIN ws USING (page, region_id) JOIN hs USING (page, region_id)),
told AS (SELECT *, x1 - x0 > {SPAN} * col_w AND free AS wide, y1 - y0 > {SPAN} * row_h AS high FROM sized)
SELECT page, region_id, r, c, CASE WHEN high THEN greatest(1, round_even((y1 - y0) / greatest(row_h, 1), 0))::BIGINT ELSE 1 END AS rowspan, CASE WHEN wide THEN greatest(1, round_even((x1 - x0) / greatest(col_w, 1), 0))::BIGINT ELSE 1 END AS colspan, text AS value FROM told WHERE text <> '' AND (wide OR high)
"""),
    words="sheet_words",
    regions="sheet_regions",
)
def tab_merged_cells(words, regions):
    """Cells that span several rows or columns."""
    return merged_cells(words, regions)
