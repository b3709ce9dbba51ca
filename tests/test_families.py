"""Criteria of single operators on hand-written tables."""

from __future__ import annotations

import io
import zipfile

import pytest

from corpusflow.functions import sequences
from corpusflow.plans import registry
from corpusflow.plans.catalog import apply
from corpusflow.plans.dialect import duck_sql, spark_sql
from corpusflow.sources import files, tables
from corpusflow.streaming import live

registry.load()


def test_macros_expand_in_both_dialects():
    sql = "SELECT $replace_all(lower(x), r'[^a-z,(]+', '-') FROM t"
    assert spark_sql(sql) == "SELECT regexp_replace(lower(x), r'[^a-z,(]+', '-') FROM t"
    assert duck_sql(sql) == "SELECT regexp_replace(lower(x), '[^a-z,(]+', '-', 'g') FROM t"


def test_page_ranges(spark):
    classes = "RRRSSDDD"
    metrics = {"R": (2000, 2, 0.1, 0.0), "S": (10, 2, 0.95, 0.0), "D": (500, 2, 0.1, 0.2)}
    rows = [(1, i, *metrics[c], 0) for i, c in enumerate(classes, 1)]
    triage = spark.createDataFrame(rows, "doc_id long, page long, chars long, fonts long, image_rate double, nonprint double, images long")
    assert {(r.cls, r.pages) for r in apply("win_page_ranges", triage=triage).collect()} == {("readable", "1-3"), ("scanned", "4-5"), ("degraded", "6-8")}
    assert apply("prj_doc_class", triage=triage).first().cls == "pdf_hybrid"


def test_version_diff(spark):
    cols = "block_id string, section_path string, content string, type string"
    old = spark.createDataFrame([("a", "/1", "x", "p"), ("b", "/1", "y", "p"), ("c", "/2", "z", "p")], cols)
    new = spark.createDataFrame([("a", "/1", "x", "p"), ("b", "/1", "Y", "p"), ("d", "/2", "w", "p")], cols)
    assert {(r.block_id, r.change) for r in apply("join_full_outer_diff", old_blocks=old, new_blocks=new).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "removed"), ("d", "added")}


def test_publishing_twice_skips(spark):
    notes = spark.createDataFrame([("n1", "h1"), ("n2", "h2"), ("n3", "h3")], "note_id string, ir_hash string")
    dest = spark.createDataFrame([("html",)], "dest string")
    manifest = spark.createDataFrame([("n1", "html", "h1", False), ("n2", "html", "old", True)], "note_id string, destination string, source_hash string, edited boolean")
    assert {(r.note_id, r.action) for r in apply("join_publish_state", notes=notes, destinations=dest, manifest=manifest).collect()} == {("n1", "skipped"), ("n2", "blocked"), ("n3", "created")}


def test_ledger_rules(spark):
    rows = [("u1", "must-keep", "pending", None, None, "b"), ("u2", "context", "discarded", "no-reason", None, "b"), ("u3", "context", "written", None, None, "b"), ("u3", "context", "written", None, "n", "b"), ("u4", "context", "discarded", "redundant-with:000000000000", None, None)]
    units = spark.createDataFrame(rows, "unit_id string, criticality string, state string, discard_reason string, target_note string, block_id string")
    got = {(r.rule_id, r.node) for r in apply("led_validate", units=units).collect()}
    assert got == {("V-LED-01", "u1"), ("V-LED-02", "u2"), ("V-LED-03", "u3"), ("V-LED-04", "u3"), ("V-LED-05", "u4"), ("V-LED-06", "u4")}


def test_axis_clusters_are_anchored(spark):
    boxes = spark.createDataFrame([(1, i, y) for i, y in enumerate([0, 30, 60, 90, 200])], "page long, word_id long, y long")
    assert {(r.anchor, r.n) for r in apply("win_axis_cluster", boxes=boxes).collect()} == {(0, 2), (60, 2), (200, 1)}


def test_sample_is_stable(spark):
    units = spark.createDataFrame([(f"u{i}", "must-keep" if i < 5 else "context") for i in range(105)], "unit_id string, criticality string")
    a = {r.unit_id for r in apply("smp_stratified", units=units).collect()}
    b = {r.unit_id for r in apply("smp_stratified", units=units.repartition(7)).collect()}
    assert a == b and len(a) == 15


@pytest.mark.parametrize(("make", "read"), [(files.make_docx, files.docx_regions), (files.make_pptx, files.pptx_regions), (files.make_epub, files.epub_regions)])
def test_packages_round_trip(make, read):
    text = "Title & <more>\nfirst line\nsecond"
    rows = list(read("x", make(text)))
    assert [r[3] for r in rows] == text.split("\n") and rows[0][1] == "heading"


def test_broken_package_is_an_error_row(spark):
    df = spark.createDataFrame([("a.docx", b"no zip"), ("b.docx", None)], "path string, content binary")
    assert [r.kind for r in files.parsed(df, "content", files.REGION, files.docx_regions).collect()] == ["error"]
    out = io.BytesIO()
    zipfile.ZipFile(out, "w").close()
    df = spark.createDataFrame([("a.docx", out.getvalue())], "path string, content binary")
    assert files.parsed(df, "content", files.REGION, files.docx_regions).first().kind == "error"


def test_html_clean_nested_boilerplate():
    html = '<title>T</title><body><nav><div><p>menu</p></div>still menu</nav><article><h2>H</h2><p>a &amp; b<p>c</article><div class="cookie">no</div></body>'
    rows = [(k, v) for _, k, _, v in files.html_clean("x", html)]
    assert rows == [("title", "T"), ("heading", "H"), ("text", "a & b"), ("text", "c")]


def test_note_language():
    text = '---\ntitle: x\n---\n# Head\nline one\nline two\n\n- item\n:::warning\nbody\n:::\n```sql\nselect 1\n```\n:::unknown\n'
    rows = [(k, v) for _, k, _, v in files.notemark_nodes("x", text)]
    assert rows[:5] == [("property", "title=x"), ("heading", "Head"), ("paragraph", "line one line two"), ("bullet", "item"), ("directive", "warning")]
    assert ("code", "select 1") in rows and sum(k == "error" for k, _ in rows) == 2


def test_markdown_reverses_render():
    body = "## Head\n\ntext here\n\n- point\n\n> note"
    assert [(k, t) for _, k, _, t in files.markdown_blocks("x", body)] == [("heading", "Head"), ("paragraph", "text here"), ("bullet", "point"), ("callout", "note")]


def test_tex():
    text = "\\newcommand{\\v}[1]{\\mathbf{#1}}\\begin{equation}\\label{a}\\v{x}\\end{equation}\\begin{align}b\\tag{Z}\\end{align}\\begin{equation}c\\end{equation}"
    assert [(k, n, t) for _, k, n, t in files.tex_environments("x", text)] == [("equation", 1, "\\mathbf{x}"), ("align", None, "b"), ("equation", 2, "c")]
    assert files.tex_flat("m", {"m": "a \\input{b} % no", "b.tex": "B \\input{m}"}).strip().startswith("a B")


def test_sequence_functions():
    assert sequences.latex_errors("\\begin{cases} x_{1} \\end{cases}") == []
    assert sequences.latex_errors("_x") == ["script without a base"] and "braces do not pair" in sequences.latex_errors("{x")
    assert sequences.fix_brackets("f([1, 2", "python") == "f([1, 2])" and sequences.fix_brackets("f)", "python") == "f)"


def test_thresholds():
    assert tables.load_thresholds('{"schema_version": 2}')[1] == ["schema version differs"]
    found, wrong = tables.load_thresholds('{"readable_chars": 5, "odd": 1}')
    assert found["readable_chars"] == 5 and wrong == ["unknown: odd"]


def test_streams(spark, tmp_path):
    rows = [(1, "pending", "2024-01-01 00:00:00"), (1, "done", "2024-01-01 01:00:00"), (1, "pending", "2024-01-01 02:00:00"), (2, "failed", "2024-01-01 00:30:00")]
    spark.createDataFrame(rows, "item long, status string, ts string").selectExpr("item", "status", "cast(ts AS timestamp) AS ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    schema = "item long, status string, ts timestamp"
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    got = live.drain(live.status_machine(read(), "item", "status"), "machine", "update")
    assert {(r.key, r.status, r.refused) for r in got.collect()} == {(1, "done", 1), (2, "failed", 0)}
    assert live.drain(live.first_wins(read(), ["item"], "ts"), "firsts", "append").count() == 2
    assert sum(r.n for r in live.drain(live.windowed_counts(read(), "ts", "1 hour"), "windows", "complete").collect()) == 4


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pdf_round_trip():
    from corpusflow.sources import pdf

    text = "Title (one)\nTitle (one)\nback \\ slash"
    rows = list(pdf.fragments("x", pdf.make_pdf(text)))
    assert [r[-1] for r in rows] == text.split("\n") and [r[2] for r in rows] == [1, 2, 3] and rows[0][6] == 18.0
    assert [r[3] for r in pdf.outline("x", pdf.make_pdf(text))] == ["/title-one", "/title-one-2", "/back-slash"]
    assert list(pdf.fragments("x", b"no pdf")) == [] and list(pdf.outline("x", b"")) == []


def test_words_cut_at_line_ends(spark):
    lines = {
        1: [("the trans-", 10.0), ("port layer uses a trans-", 10.0), ("mitter. transport transmitter", 10.0)],
        2: [("physics-", 10.0), ("based model", 10.0)],
        3: [("a well-known re-", 10.0), ("sult, here", 12.0)],  # another size
        4: [("a cut-", 10.0), ("word", 10.0)],  # the next line would be empty
        5: [("some long-", 10.0), ("term, plan", 10.0), ("long-term", 10.0)],
        6: [("un-", 10.0), ("do it", 10.0)],
    }
    rows = [(d, i, t, "paragraph", s) for d, own in lines.items() for i, (t, s) in enumerate(own)] + [(7, 0, "head-", "heading", 10.0), (7, 1, "line of text", "paragraph", 10.0)]
    got = {(r.doc_id, r.block_index): r.text for r in apply("fn_dehyphenate", fragments=spark.createDataFrame(rows, "doc_id long, block_index long, text string, type string, font_size double")).collect()}
    assert [got[1, i] for i in range(3)] == ["the transport", "layer uses a transmitter.", "transport transmitter"]
    assert [got[2, i] for i in range(2)] == ["physics-based", "model"]
    assert got[3, 0] == "a well-known re-" and got[4, 1] == "word" and got[7, 0] == "head-"
    assert [got[5, i] for i in range(3)] == ["some long-term,", "plan", "long-term"]
    assert [got[6, i] for i in range(2)] == ["undo", "it"]


def test_fragments_are_dealt_once_and_rows_without_a_document_stay(spark):
    rows = [(None, 0, "un-", "paragraph", 10.0), (None, 1, "do it", "paragraph", 10.0), (1, 0, "re-", "paragraph", 10.0), (1, 1, "do it", "paragraph", 10.0), (1, 2, None, "paragraph", 10.0), (2, 0, "redo re-do", "paragraph", 10.0)]
    out = apply("fn_dehyphenate", fragments=spark.createDataFrame(rows, "doc_id long, block_index long, text string, type string, font_size double"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(((r.doc_id or 0, r.block_index), r.text, r.moved, r.kept) for r in out.collect()) == [
        ((0, 0), "un-", None, None), ((0, 1), "do it", None, None), ((1, 0), "re-do", "do", True), ((1, 1), "it", None, None), ((1, 2), None, None, None), ((2, 0), "redo re-do", None, None)
    ]


def test_slugs_keep_no_edge_hyphens(spark):
    rows = [(1, 0, "-- Intro!", "heading"), (1, 1, "Intro", "heading"), (1, 2, "text", "paragraph"), (1, 3, "(intro)", "heading")]
    blocks = spark.createDataFrame(rows, "doc_id long, block_index long, content string, type string")
    assert sorted((r.block_index, r.slug) for r in apply("win_slug_suffix", blocks=blocks).collect()) == [(0, "intro"), (1, "intro-2"), (3, "intro-3")]
    paths = {r.block_index: (r.level, r.section_path) for r in apply("win_heading_path", blocks=blocks).collect()}
    assert paths == {0: (2, "/intro"), 1: (3, "/intro/intro"), 3: (2, "/intro")}


def test_pair_decisions(spark):
    text = "one two three four five six seven eight nine ten " * 5
    notes = [("a", "concept", "Lock", [], text), ("b", "concept", "lock", [], text), ("c", "concept", "Lock", [], text[: len(text) // 2] + "zq" * (len(text) // 4)), ("d", "procedure", "Lock", [], text), ("e", "concept", "Other", ["x"], text)]
    df = spark.createDataFrame(notes, "note_id string, note_type string, title string, aliases array<string>, body string")
    got = {(r.a, r.b): r.decision for r in sequences.decided_pairs(df).collect()}
    assert got[("a", "b")] == "merge" and ("a", "d") not in got and ("a", "e") not in got
    pairs = spark.createDataFrame([("p", "q", True, False, 0.4), ("p", "r", True, False, 0.2), ("p", "s", False, False, 0.7), ("p", "t", False, False, 0.9), ("p", "u", False, False, 0.5), ("p", "v", False, False, 0.3)], "a string, b string, canonical boolean, alias boolean, sim double")
    assert {r.b: (r.decision, r.confidence) for r in apply("sim_pair_decision", pairs=pairs).collect()} == {"q": ("conflict", 0.7), "r": ("merge", 0.95), "s": ("specialize", 0.7), "t": ("merge", 0.9), "u": ("review", 0.5)}


def test_run_limits(spark):
    rows = [("n", i, "callout" if i < 4 else "bullet" if i < 9 else "callout" if i < 12 else "bullet") for i in range(18)]
    nodes = spark.createDataFrame(rows, "note_id string, ord long, node string")
    assert [(r.first_ord, r.n) for r in apply("win_callout_run", nodes=nodes).collect()] == [(0, 4)]
    assert [(r.first_ord, r.n) for r in apply("win_bullet_run", nodes=nodes).collect()] == [(12, 6)]
