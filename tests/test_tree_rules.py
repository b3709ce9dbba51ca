"""Rules of note trees, colours, samples and runs of prose on inputs written by hand."""

from __future__ import annotations

import math

import pytest

from corpusflow.operators import ordering, tree_rules
from corpusflow.plans import registry
from corpusflow.plans.catalog import apply

registry.load()
NODES = "note_id string, path string, parent string, ord long, node string, text string, name string, capability string, ref_block string, ref_hash string"
ID, HASH = "0123456789ab", "a" * 64


def tree(spark, *nodes):
    """Nodes as (path, node, values that differ from a sound node's)."""
    rows = []
    for path, node, *more in nodes:
        r = {"text": "t", "name": "note" if node == "admonition" else ID if node == "source-ref" else "", "capability": "text", "ref_block": None, "ref_hash": None} | (more[0] if more else {})
        rows.append(("n", path, path.rpartition("/")[0], int(path.rpartition("/")[2]), node, r["text"], r["name"], r["capability"], r["ref_block"], r["ref_hash"]))
    return spark.createDataFrame(rows, NODES)


def broken(spark, nodes, fields=()):
    blocks = spark.createDataFrame([(ID,)], "block_id string")
    heads = spark.createDataFrame([("n", k, v, False) for k, v in fields], "note_id string, key string, value string, is_list boolean")
    return sorted((r.rule_id, r.severity, r.path) for r in apply("val_ir", ir_nodes=nodes, blocks=blocks, note_fields=heads).collect())


SOUND = [("0", "section"), ("0/0", "text"), ("1", "paragraph"), ("1/0", "text"), ("1/1", "source-ref"), ("2", "list"), ("2/0", "paragraph"), ("2/0/0", "text"), ("2/1", "text"), ("3", "question"), ("3/0", "list"), ("3/0/0", "text"), ("3/0/1", "em"), ("4", "admonition"), ("4/0", "text"), ("5", "code")]


def test_a_sound_tree(spark):
    assert broken(spark, tree(spark, *SOUND)) == []
    assert broken(spark, tree(spark)) == []


@pytest.mark.parametrize(
    "rule,severity,node",
    [
        ("E1", "error", ("9", "poem")),
        ("E2", "error", ("9", "divider", {"capability": None})),
        ("W11", "warning", ("9", "divider", {"capability": "sparkle"})),
        ("E3", "error", ("9", "divider", {"ref_block": "", "ref_hash": HASH})),
        ("E3", "error", ("9", "divider", {"ref_block": "XYZ", "ref_hash": HASH})),
        ("E3", "error", ("9", "divider", {"ref_block": ID, "ref_hash": "short"})),
        (None, None, ("9", "divider", {"ref_block": ID, "ref_hash": ""})),
        ("E4", "error", ("4", "admonition", {"name": "loud"})),
        ("E5", "error", ("1/1", "source-ref", {"name": "ffffffffffff"})),
        ("W3", "warning", ("9", "section")),
        ("W5", "warning", ("5", "code", {"text": " \n "})),
        ("W7", "warning", ("0/0", "text", {"text": ""})),
        ("W10", "warning", ("9", "question")),
        ("W6", "warning", ("9", "admonition")),
        ("W4", "warning", ("9", "paragraph")),
    ],
)
def test_each_rule_alone(spark, rule, severity, node):
    nodes = [n for n in SOUND if n[0] != node[0]] + [node]
    assert broken(spark, tree(spark, *nodes)) == ([(rule, severity, node[0])] if rule else [])


def test_rules_of_children(spark):
    assert broken(spark, tree(spark, ("0", "list"), ("0/0", "text"))) == [("W2", "warning", "0")]
    assert broken(spark, tree(spark, ("0", "paragraph"), ("0/0", "text"), ("0/1", "source-ref"), ("0/2", "source-ref"))) == [("W8", "warning", "0")]
    assert broken(spark, tree(spark, ("0", "paragraph"), ("0/0", "source-ref", {"name": "bad", "text": ""}))) == [("E5", "error", "0/0"), ("E6", "error", "0/0"), ("W4", "warning", "0")]
    wrong = {"paragraph": "code", "strong": "paragraph", "code": "text", "table": "paragraph", "list": "list", "quote": "table"}
    for parent, child in wrong.items():
        got = broken(spark, tree(spark, ("0", parent), ("0/0", child), ("0/1", child)))
        assert ("E1b", "error", "0/0") in got, (parent, child)
    assert [r for r, *_ in broken(spark, tree(spark, ("0", "parameter-table"), ("0/0", "table"), ("0/1", "text")))] == []


def test_rules_of_headers(spark):
    full = [("title", "T"), ("note-type", "x"), ("status", "published"), ("summary", "s"), ("reading-time-minutes", "3")]
    assert broken(spark, tree(spark), full) == []
    assert broken(spark, tree(spark), [("status", "published")]) == [(f"E01{c}", "error", "/frontmatter") for c in ("NO", "RE", "SU", "TI")]
    assert broken(spark, tree(spark), [("status", "draft")]) == [("E01NO", "warning", "/frontmatter"), ("E01TI", "warning", "/frontmatter")]
    other = dict(full) | {"summary": "x" * 201, "reading-time-minutes": "0"}
    assert [r for r, *_ in broken(spark, tree(spark), other.items())] == ["E03RT", "E03SU"]
    assert [r for r, *_ in broken(spark, tree(spark), (dict(full) | {"summary": "a\tb", "reading-time-minutes": "soon"}).items())] == ["E02RT", "E03SC"]


def lab(code):
    r, g, b = (c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (int(code[i : i + 2], 16) / 255 for i in (1, 3, 5)))
    x, y, z = (sum(m * c for m, c in zip(row, (r, g, b))) for row in ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)))
    f = lambda t: t ** (1 / 3) if t > (6 / 29) ** 3 else t / (3 * (6 / 29) ** 3)
    fx, fy, fz = f(x / 0.95047), f(y), f(z / 1.08883)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def test_palettes(spark):
    colors = {"navy": "#000080", "teal": "#008080", "mint": "#a0ffc8", "white": "#ffffff", "black": "#000000"}
    df = spark.createDataFrame([("p", n, c) for n, c in colors.items()], "palette string, name string, hex string")
    order = sorted(colors, key=lambda n: lab(colors[n])[0])
    got = {r.name: r for r in apply("fn_color_lab", colors=df).collect()}
    for a, b in zip(order, order[1:]):
        want = math.dist(lab(colors[a]), lab(colors[b]))
        assert got[a].next_name == b and got[a].delta_e == pytest.approx(want, abs=0.006) and got[a].safe == (round(want, 2) >= 20)
    assert got[order[-1]].next_name is None and got[order[-1]].safe
    assert (got["teal"].lightness, got["teal"].a, got["teal"].b) == pytest.approx(lab("#008080"), abs=1e-6)
    pairs = spark.createDataFrame([("p", "black", "white", False), ("p", "white", "mint", True), ("p", "navy", "teal", False)], "palette string, text_name string, back_name string, large boolean")
    ratios = {(r.text_name, r.back_name): (r.ratio, r.passes) for r in apply("val_contrast", colors=df, color_pairs=pairs).collect()}
    assert ratios["black", "white"] == (21.0, True) and not ratios["white", "mint"][1] and not ratios["navy", "teal"][1]


def test_runs_of_prose_begin_anew(spark):
    nodes = [("n", i, "paragraph" if w else "callout", w) for i, w in enumerate([90, 90, 90, 150, 60, 0, 150, 0, 150, 300])]
    got = apply("win_prose_run", nodes=spark.createDataFrame(nodes, "note_id string, ord long, node string, n_words long"))
    assert sorted(r.ord for r in got.collect()) == [0, 3, 8]


def test_samples_by_stratum(spark):
    units = spark.createDataFrame([(f"u{i}", "must-keep" if i % 10 == 0 else "rare" if i % 100 == 1 else "context") for i in range(400)], "unit_id string, criticality string").repartition(7)
    for f, sizes in ((ordering.smp_stratified, {"must-keep": 40, "rare": 1, "context": 36}), (ordering.smp_stratified_audit, {"must-keep": 40, "rare": 4, "context": 35})):
        got = f(units).collect()
        assert {k: sum(r.criticality == k for r in got) for k in sizes} == sizes
        assert sorted(got) == sorted(f(units.repartition(2)).collect())


def test_catalogue_of_rules():
    assert len(tree_rules._NODE_RULES) == 14
