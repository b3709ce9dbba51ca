"""Marks, diagrams, crawls and tables on inputs written by hand."""

from __future__ import annotations

import pytest

from corpusflow.functions import marks as K
from corpusflow.operators import diagrams as D
from corpusflow.operators import grids as G
from corpusflow.plans import registry
from corpusflow.sources import crawl as W

registry.load()


def test_each_mark_nested_and_unclosed(spark):
    lines = {
        1: "a {src:blk_0123456789ab} [[term:x-1]] [[note:N_1]] {{who}} {derived} {external} [[fn:2]] [[kbd:Ctrl+C]] ~~no~~ {layer:l3} $y$",
        2: "~~out [[term:in]] $m {{p}}$ end~~",
        3: "[[term:open ~~x and $y",
        4: "{layer:l9} {{9}} ~~a~~b~~",
        5: "plain",
        6: None,
        7: "$a$$b$",
    }
    got = {}
    for r in K.marks(spark.createDataFrame(list(lines.items()), "id long, line string")).collect():
        got.setdefault(r.id, []).append((r.kind, r.match, r.value, r.start, r.stop, r.depth))
        assert lines[r.id][r.start : r.stop] == r.match
    assert sorted(got) == [1, 2, 3, 4, 7]
    assert {(k, v, d) for k, _, v, _, _, d in got[1]} == {("source-ref", "blk_0123456789ab", 0), ("term-ref", "x-1", 0), ("link-note", "N_1", 0), ("placeholder", "who", 0), ("derived", None, 0), ("external", None, 0), ("footnote-ref", "2", 0), ("keyboard", "Ctrl+C", 0), ("deleted", "no", 0), ("layer-mark", "l3", 0), ("math-inline", "y", 0)}
    assert {(k, d) for k, *_, d in got[2]} == {("deleted", 0), ("term-ref", 1), ("math-inline", 1), ("placeholder", 2)}
    assert [(k, m, s) for k, m, _, s, _, _ in sorted(got[3], key=lambda x: x[3])] == [("unclosed", "[[", 0), ("unclosed", "~~", 12), ("unclosed", "$", 20)]
    assert sorted((k, m) for k, m, *_ in got[4]) == [("deleted", "~~a~~"), ("unclosed", "{layer:"), ("unclosed", "{{"), ("unclosed", "~~")]
    assert [(k, v, d) for k, _, v, _, _, d in sorted(got[7], key=lambda x: x[3])] == [("math-inline", "a", 0), ("math-inline", "b", 0)]


def flow(n, head="flowchart TD"):
    return head + "\n" + "\n".join(f'n{i}["x"] --> n{i + 1}' for i in range(n - 1))


#: What is broken -> diagrams that break only that.
BROKEN = {
    "": ['flowchart TD\nA["a"] -->|yes| B("b")\nB --> C --> A', "graph LR\nsubgraph one\nA\nend\nsubgraph two\nB\nend", "sequenceDiagram\nparticipant A\nA->>B: hi\nalt x\nA->>B: y\nelse z\nend", "stateDiagram-v2\n[*] --> S", "erDiagram\nA ||--o{ B : has", "gantt\ndateFormat YYYY\nx : a, 1", 'pie\n"a" : 3', "classDiagram\nA <|-- B", "gitGraph\ncommit", 'flowchart TD\nA["say end-to-end (well"]', "\n\nflowchart TD\nA"],
    "S-01": ["mindmap\nroot", "", None],
    "S-02": ['flowchart\nA["a"]', "graph"],
    "S-03": ['flowchart TD\nA["a"'],
    "S-04": ["sequenceDiagram\n1A->>B: x\nA->>2B: y"],
    "S-05": ["sequenceDiagram\nparticipant A", "sequenceDiagram\nA->>B: x\nalt y\nend"],
    "S-06": ["stateDiagram-v2\nA --> B"],
    "S-07": ["erDiagram\nA ??-- B : has"],
    "S-08": ["gantt\nx : a, 1"],
    "P-01": ["flowchart TD\nA[plain] --> B"],
    "P-02": ["flowchart TD\nniño-->B"],
    "P-03": ["flowchart TD\nA\nstyle A fill:#fff"],
    "P-04": ['flowchart TD\nA\nclick A "u"\nlinkStyle 0 stroke:red'],
    "P-05": ["flowchart TD\n%%{init: {'theme':'x'}}%%\nA"],
    "P-06": ['flowchart TD\nA["<b>x</b> <i>y</i>"]'],
    "L-01": [flow(16), "pie\n" + "\n".join(f'"{i}" : 1' for i in range(16))],
    "L-04": ['flowchart TD\nA["' + "x" * 41 + '"]', 'flowchart TD\nA["<br/>' + "x" * 60 + '"]'],
    "L-05": ["flowchart TD\nsubgraph a\nsubgraph b\nsubgraph c\nX\nend end\nend"],
    "L-01 L-02": ["gantt\ndateFormat Y\n" + "\n".join(f"t{i} : a, {i}" for i in range(20))],
    "L-01 L-03": ["flowchart TD\nsubgraph s\n" + flow(20).split("\n", 1)[1] + "\nend"],
}


def test_each_rule_of_diagrams(spark):
    cases = [(rules, text) for rules, texts in BROKEN.items() for text in texts]
    rows = [(i, "d", "alt", text) for i, (_, text) in enumerate(cases)] + [(900, "d", "", "pie"), (901, "d", None, "pie")]
    got = {}
    for r in D.violations(spark.createDataFrame(rows, "diagram_id long, src string, alt string, content string")).collect():
        got.setdefault(r.diagram_id, {})[r.rule_id] = (r.severity, r.n)
    for i, (rules, text) in enumerate(cases):
        assert set(got.get(i, {})) == set(rules.split()), (rules, text)
    assert got[900] == got[901] == {"L-06": ("warning", 1)}
    at = {text: i for i, (_, text) in enumerate(cases)}
    assert got[at[BROKEN["S-04"][0]]]["S-04"] == ("error", 2) and got[at[BROKEN["P-04"][0]]]["P-04"] == ("error", 2)
    assert got[at[BROKEN["S-05"][0]]]["S-05"] == ("error", 1) and got[at[BROKEN["S-05"][1]]]["S-05"] == ("warning", 1)
    assert set(D.BROKEN) == set(D.SEVERITIES) and len(D.BROKEN) == 20


BASE = "https://e.org/docs"


def site(spark, pages, robots=""):
    rows = [(i, p, "".join(f'<p><a class="x" href="{h}">t</a>' for h in hrefs)) for i, (p, hrefs) in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, path string, html string"), spark.createDataFrame([(robots,)], "content string")


def crawled(spark, pages, robots="", **how):
    return [(r.path, r.depth) for r in W.crawl(*site(spark, pages, robots), BASE, "/docs/index.html", **how).orderBy("place").collect()]


PAGES = [
    ("/docs/index.html", ["install.html", "/docs/config.html#top", "https://e.org/docs/never.html", "#x", "mailto:a@b", "/other/x.html", "missing.html", "config.html?a=1"]),
    ("/docs/config.html", ["api.html", "index.html", "install.html"]),
    ("/docs/install.html", ["deep.html", "api.html"]),
    ("/docs/api.html", ["end.html"]),
    ("/docs/deep.html", []),
    ("/docs/end.html", ["index.html"]),
    ("/docs/never.html", []),
    ("/other/x.html", []),
]


def test_crawl_order_depth_and_limits(spark):
    want = [("/docs/index.html", 0), ("/docs/install.html", 1), ("/docs/config.html", 1), ("/docs/deep.html", 2), ("/docs/api.html", 2), ("/docs/end.html", 3)]
    assert crawled(spark, PAGES) == want
    assert crawled(spark, PAGES, max_depth=1) == want[:3]
    assert crawled(spark, PAGES, max_pages=4) == want[:4]
    assert crawled(spark, PAGES[1:]) == []


def test_robots_lines(spark):
    robots = "User-agent: *\nDisallow: /docs/a\nAllow: /docs/api\ndisallow:/docs/inst # no\nDisallow: /\nDisallow:\n"
    pages, lines = site(spark, PAGES, robots)
    got = {r.path: (r.allowed, r.rule) for r in W.judged(pages.select("path"), lines).collect()}
    assert got["/docs/api.html"] == (True, "/docs/api") and got["/docs/install.html"] == (False, "/docs/inst") and got["/docs/config.html"] == (True, None)
    assert crawled(spark, PAGES, robots) == [("/docs/index.html", 0), ("/docs/config.html", 1), ("/docs/api.html", 2), ("/docs/end.html", 3)]
    assert {r.path for r in W.judged(pages.select("path"), site(spark, PAGES, "")[1]).where("allowed").collect()} == {p for p, _ in PAGES}


WORDS = "page long, word_id long, x double, y double, w double, h double, font_size double, font_name string, text string"
REGIONS = "page long, region_id long, x double, y double, w double, h double"


def grid(rows, page=1, font=lambda r: "Serif"):
    return [(page, r * 10 + c, 100.0 * c, 500.0 - 20 * r, 30.0, 10.0, 10.0, font(r), t) for r, row in enumerate(rows) for c, t in enumerate(row) if t is not None]


def test_a_large_table(spark):
    words = grid([[f"{r}.{c}" for c in range(5)] for r in range(36)], font=lambda r: "Serif-Bold" if r == 0 else "Serif")
    words = [(*w[:3], w[3] + 400, *w[4:]) for w in words]
    regions = spark.createDataFrame([(1, 7, -5.0, 0.0, 700.0, 1000.0), (2, 1, 0.0, 0.0, 9.0, 9.0)], REGIONS)
    got = G.tables(spark.createDataFrame(words, WORDS), regions).orderBy("row_no").collect()
    assert len(got) == 36 and {(r.region_id, r.rows, r.cols, r.confidence) for r in got} == {(7, 35, 5, 0.92)}
    assert got[0].header and got[0].row_text == "0.0|0.1|0.2|0.3|0.4" and not got[1].header and got[35].row_text == "35.0|35.1|35.2|35.3|35.4"
    assert G.merged_cells(spark.createDataFrame(words, WORDS), regions).count() == 0


def test_uncertain_and_uneven_tables(spark):
    words = grid([["a", "b"], ["c"]]) + [(1, 90, 104.0, 501.0, 20.0, 10.0, 10.0, None, " b2 ")] + grid([["x", "y", "z"]], page=2) + [(2, 91, 0.0, 480.0, 5.0, 5.0, None, None, None)]
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 400.0, 600.0), (2, 1, 0.0, 0.0, 400.0, 600.0)], REGIONS)
    got = [(r.page, r.row_no, r.header, r.row_text, r.rows, r.confidence) for r in G.tables(spark.createDataFrame(words, WORDS), regions).orderBy("page", "row_no").collect()]
    assert got == [(1, 0, False, "a|b b2", 2, 0.6), (1, 1, False, "c|", 2, 0.6)]


def test_spans_of_columns_and_rows(spark):
    words = grid([[f"{r}{c}" for c in range(4)] for r in range(4)])
    words = [w for w in words if w[1] not in (0, 1, 2, 3)] + [(1, 0, 0.0, 500.0, 330.0, 10.0, 10.0, "Serif", "Title")]
    words = [(*w[:3], w[3] - 60, w[4], 130.0, *w[6:]) if w[1] == 33 else w for w in words]
    regions = spark.createDataFrame([(1, 1, -5.0, 0.0, 500.0, 700.0)], REGIONS)
    got = {(r.r, r.c, r.rowspan, r.colspan, r.value) for r in G.merged_cells(spark.createDataFrame(words, WORDS), regions).collect()}
    title = [g for g in got if g[4] == "Title"]
    assert len(title) == 1 and title[0][2] == 1 and title[0][3] > 1
    assert [g[3] for g in got if g[4] == "33"] == [1] and [g[2] > 1 for g in got if g[4] == "33"] == [True]
    assert len(got) == 2


@pytest.mark.parametrize("make", [lambda s: G.tables(s.createDataFrame([], WORDS), s.createDataFrame([], REGIONS)), lambda s: K.marks(s.createDataFrame([], "id long, line string")), lambda s: D.violations(s.createDataFrame([], "diagram_id long, src string, alt string, content string"))])
def test_nothing_from_nothing(spark, make):
    assert make(spark).count() == 0


@pytest.mark.parametrize("name", ["tab_extract", "tab_merged_cells"])
def test_words_of_a_page_are_dealt_once(spark, name):
    """Lines by page once, and the regions of both kinds; no exchange of words or cells."""
    done = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert done.count("Exchange hashpartitioning") <= 5
