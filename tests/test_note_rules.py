"""Rules of notes on hand-made notes."""

from __future__ import annotations

from corpusflow.plans import catalog, registry

registry.load()
FIELDS = "note_id string, key string, value string, is_list boolean"
LINES = "note_id string, note_type string, ord long, line string"
BLOCKS = "note_id string, note_type string, section long, heading string, section_lines long, ord long, kind string, n_words long, n_lines long, items long, checklist boolean, anchor boolean, factual boolean, has_src boolean"


def header(spark, **of):
    return spark.createDataFrame([(n, k, v if isinstance(v, str) else ",".join(v), not isinstance(v, str)) for n, d in of.items() for k, v in d.items()], FIELDS)


def body(spark, kind="concept", **of):
    return spark.createDataFrame([(n, kind, i, x) for n, text in of.items() for i, x in enumerate(text.split("\n"), 1)], LINES)


def found(df):
    return sorted(tuple(r[c] for c in ("note_id", "rule_id", "severity", "node")) for r in df.collect())


def test_notemark(spark):
    fields = header(spark, a={"title": "t", "note-type": "concept", "status": "draft"}, b={"title": "t"})
    lines = body(
        spark,
        a=":::note\nx {src:blk_0123456789ab} {src:blk_zz} {src:page}\n:::\n:::tip {open}\n:::aside\n:::\n{layer:l1} {layer: l9 }",
        b="[[term:ok]] [[term:cut\n{{}} {{name}} {{ }}\n[[note:]] [[note:x]]\n:::\n:::note\n:::tip\n:::note\n:::",
        c="no header {{}}",
    )
    assert found(catalog.apply("val_notemark", note_fields=fields, note_lines=lines)) == [
        ("a", "V-NM-03", "error", "line 5"),
        ("a", "V-NM-04", "error", "directive::aside"),
        ("a", "V-NM-05", "error", "line 2"),
        ("a", "V-NM-08", "error", "line 7"),
        ("b", "V-NM-02", "error", "frontmatter.note-type"),
        ("b", "V-NM-02", "error", "frontmatter.status"),
        ("b", "V-NM-04", "error", "directive::note"),
        ("b", "V-NM-04", "error", "directive::tip"),
        ("b", "V-NM-06", "warning", "line 1"),
        ("b", "V-NM-07", "error", "line 3"),
        ("b", "V-NM-09", "warning", "line 2"),
        ("b", "V-NM-09", "warning", "line 2"),
        ("c", "V-NM-01", "error", "<frontmatter>"),
    ]


def test_properties(spark):
    fields = header(
        spark,
        a={"title": "", "note-type": "poem", "status": "published", "summary": "s" * 201, "reading-time-minutes": "0", "tags": "one", "mood": "x", "source-type": "rumour"},
        b={"title": "t", "note-type": "concept", "status": "published", "summary": "s" * 200, "reading-time-minutes": " 05", "tags": ["one"], "source-type": "book"},
    )
    assert found(catalog.apply("val_properties", note_fields=fields, note_lines=body(spark, a="x", b="x", c="x"))) == [
        ("a", "V-PR-02", "error", "mood"),
        ("a", "V-PR-03", "error", "note-type"),
        ("a", "V-PR-03", "warning", "source-type"),
        ("a", "V-PR-04", "error", "title"),
        ("a", "V-PR-05", "warning", "tags"),
        ("a", "V-PR-06", "error", "reading-time-minutes"),
        ("a", "V-PR-07", "warning", "summary"),
        ("c", "V-PR-01", "error", "<frontmatter>"),
    ]


def test_lengths(spark):
    words = lambda n: " ".join(["w"] * n)
    lines = body(spark, a=f"## TL;DR\n{words(60)}\n### more\n{words(9)}\n## Empty\nshort\n## Deep\n### x", b=f"## tldr\n{words(61)}")
    assert found(catalog.apply("val_lengths", note_lines=lines)) == [("a", "V-LEN-06", "warning", "line 5"), ("b", "V-LEN-01", "warning", "## TL;DR")]
    digest = body(spark, "chapter-digest", a=f"## TL;DR\n{words(120)}", b=f"## TL;DR\n{words(121)}")
    assert found(catalog.apply("val_lengths", note_lines=digest)) == [("b", "V-LEN-05", "warning", "## TL;DR")]
    terms = body(spark, "glossary-term", a="x\n\n" * 30, b="x\n" * 31)
    assert found(catalog.apply("val_lengths", note_lines=terms)) == [("b", "V-LEN-03", "error", "<root>")]


def test_tables(spark):
    lines = body(
        spark,
        a="| a | b |\n|---|---|\n| x |  |\n\n| a | b |\n|---|---|\n| x |\n\n| a | b |\n|---|---|",
        b="| lost |\n| lost |\n| a | b |\n|---|---|\n| x | y |\n|---|---|\n|  | y |",
        c="| a | b |\n| c | d |\n|---|---|\n| x |",
    )
    assert found(catalog.apply("val_tables", note_lines=lines)) == [
        ("a", "V-TBL-02", "warning", "line 9"),
        ("a", "V-TBL-03", "warning", "line 1 row 2 column 2"),
        ("a", "V-TBL-04", "error", "line 5"),
        ("b", "V-TBL-03", "warning", "line 3 row 3 column 1"),
    ]


def test_images(spark):
    assets = spark.createDataFrame([("a.png", 1), ("b.bmp", 10 * 1024 * 1024 + 1)], "path string, bytes long")
    lines = body(spark, a=":::figure\n![x](a.png)\nA caption.\n:::\n:::figure\ntext\n:::\n:::", b="![](a.png) ![y](b.bmp) ![z](gone.png) ![w](https://h/x.png)\n:::figure\n:::figure\n![x](a.png)\n:::")
    assert found(catalog.apply("val_images", note_lines=lines, note_assets=assets)) == [
        ("a", "V-IMG-05", "info", "line 5"),
        ("a", "V-IMG-05", "warning", "line 5"),
        ("b", "V-IMG-01", "error", "line 1"),
        ("b", "V-IMG-02", "error", "line 1"),
        ("b", "V-IMG-03", "warning", "line 1"),
        ("b", "V-IMG-04", "warning", "line 1"),
        ("b", "V-IMG-05", "info", "line 3"),
    ]


def test_density(spark):
    def of(note, section, heading, kinds, note_type="concept", lines=10):
        return [(note, note_type, section, heading, lines, section * 100 + i, k, w, 1, w, check, k in ("table", "callout", "figure"), k == "paragraph", src) for i, (k, w, check, src) in enumerate(kinds)]

    p = lambda w, src=True: ("paragraph", w, False, src)
    x = lambda k: (k, 1, False, False)
    rows = of("a", 0, "## TL;DR", [p(61), p(60)]) + of("a", 1, "## B", [p(150), p(51), p(150), x("table"), p(150), p(201)])
    rows += of("b", 0, "## B", [x("callout")] * 8) + of("b", 1, "## C", [("list", 3, False, False), ("list", 3, True, False), ("list", 3, False, False), ("list", 5, False, False)])
    rows += of("c", 0, "## B", [p(1, False)] * 2 + [p(1)] * 3, lines=101) + of("c", 1, "## Errores registrados", [p(1, False)] * 9) + of("c", 2, "### Sub", [p(1, False)])
    rows += of("d", 0, "## B", [("list", 9, False, False)], "cheatsheet") + of("d", 1, "## C", [x("paragraph"), x("collapsible")], "cheatsheet", 200)
    assert found(catalog.apply("val_density", note_blocks=spark.createDataFrame(rows, BLOCKS))) == [
        ("a", "R1", "warning", "## TL;DR:paragraph:0"),
        ("a", "R2", "error", "## B:paragraph:105"),
        ("a", "R3", "warning", "## B:paragraph:100"),
        ("a", "R3", "warning", "## B:paragraph:104"),
        ("b", "R4", "error", "## B:callout:3"),
        ("b", "R4", "error", "## B:callout:7"),
        ("b", "R5", "error", "## C:list:102"),
        ("b", "R6", "error", "## C"),
        ("c", "R7", "warning", "## B"),
        ("c", "R8", "warning", "/"),
    ]


def test_links(spark):
    lines = body(spark, a="one two three four [[note:b]] [[note:b]]\nsee all of that in [[note:c]]", b="x [[note:a]]\none two three four five [[note:gone]] [[note:gone]]", c="none")
    assert found(catalog.apply("val_links", note_lines=lines)) == [
        ("a", "V-LK-02", "warning", "line 1"),
        ("a", "V-LK-03", "info", "c"),
        ("a", "V-LK-04", "warning", "a"),
        ("b", "V-LK-01", "error", "gone"),
        ("b", "V-LK-01", "error", "gone"),
        ("b", "V-LK-02", "warning", "line 1"),
        ("b", "V-LK-04", "warning", "b"),
    ]


def test_destinations(spark):
    make = spark.createDataFrame
    notes, dests = make([("a",), ("b",)], "note_id string"), make([("html",), ("notion",)], "dest string")
    nodes = make([("a", "a text of over thirty characters, whole"), ("a", "also a text of over twenty"), ("a", "short")], "note_id string, text string")
    gone = make([("a", "html", False), ("a", "notion", True), ("b", "html", False)], "note_id string, dest string, content_intact boolean")
    drawn = make([("a", "html", "a text of over thirty characte... also a text of over twenty"), ("a", "notion", "nothing")], "note_id string, dest string, text string")
    run = lambda n, r: found(catalog.apply("val_destinations", notes=n, destinations=dests, nodes=nodes, renders=r, degradations=gone))
    assert run(notes, drawn) == [("a", "V-DST-01", "error", "notion"), ("a", "V-DST-02", "warning", "html"), ("b", "V-DST-00", "info", "html"), ("b", "V-DST-00", "info", "notion")]
    assert ("", "V-DST-05", "warning", "") in run(notes, drawn.limit(0))
    assert run(notes.limit(0), drawn.limit(0)) == [("", "V-DST-04", "warning", "")]


def test_stored_blocks(spark):
    good = ("a", "1", "0123456789ab", "/s", 1, "f" * 64, "native", None, "prose")
    rows = [good, ("a", "2", "0123456789ab", "/s", None, "f" * 64, "ocr", None, "poem"), ("b", "1", "xyz", "", None, "f" * 63, "", 0.5, "table"), ("b", "2", "", "", 2, "f" * 63, "ocr", 0.5, "")]
    blocks = spark.createDataFrame(rows, "note_id string, node string, block_id string, section_path string, page long, source_hash string, origin string, confidence double, type string")
    assert found(catalog.apply("val_sdm", stored_blocks=blocks)) == [
        ("a", "V-SDM-03", "error", "2"),
        ("a", "V-SDM-05", "warning", "2"),
        ("a", "V-SDM-06", "error", "2"),
        ("b", "V-SDM-01", "error", "1"),
        ("b", "V-SDM-02", "error", "1"),
        ("b", "V-SDM-04", "warning", "1"),
        ("b", "V-SDM-07", "error", "source.hash"),
    ]
