"""Rendering of note trees against files written by hand."""

from __future__ import annotations

from corpusflow.operators import note_tree as T
from corpusflow.plans import registry

registry.load()


def rows(note, nodes, parent="", depth=1):
    """Tree rows of nested (node, attributes, children)."""
    out = []
    for i, (node, attrs, *children) in enumerate(nodes):
        path = f"{parent}/{i}" if parent else str(i)
        out.append((note, path, parent, depth, i, node, attrs.get("text"), attrs.get("name"), attrs.get("title"), attrs.get("flag")))
        out += rows(note, children, path, depth + 1)
    return out


def text(t):
    return ("text", {"text": t})


def rendered(spark, notes):
    tree = spark.createDataFrame([r for note, nodes in notes.items() for r in rows(note, nodes)], T.SCHEMA)
    heads = spark.createDataFrame([(n, f"Title of {n}", "src", "ir") for n in notes], "note_id string, title string, source_hash string, ir_hash string")
    return {r.note_id: r.text for r in T.markdown(tree, heads, "2024-05-01T00:00:00Z", "2.0.0").collect()}


HEADER = '---\nschema_version: "1.0.0"\ntarget: markdown\nnote_id: "{0}"\nsource_hash: "src"\nir_sha256: "ir"\nrendered_at: "2024-05-01T00:00:00Z"\nrenderer_version: "2.0.0"\ntitle: "Title of {0}"\n{1}---\n\n# Title of {0}\n'


def test_blocks_and_inline_marks(spark):
    note = [
        ("section", {"name": "2"}, text("Head "), ("code-inline", {"text": "x"})),
        ("section", {"name": "9"}, text("deep")),
        ("paragraph", {}, text("A "), ("strong", {}, text("bold "), ("em", {}, text("both"))), ("deleted", {}, text("gone")), ("footnote-ref", {"name": "1", "text": "see"}), ("footnote-ref", {"name": "2"})),
        ("code", {"name": "PY", "text": "print(1)\nx"}),
        ("code", {"name": "cobol", "text": "STOP"}),
        ("console", {"text": "ls\n$ pwd"}),
        ("equation", {"text": "e=mc^2", "flag": True}),
        ("equation", {"text": "x"}),
        ("divider", {}),
        ("figure", {"name": "./a/b.png", "text": "alt", "title": "Cap"}),
        ("figure", {"name": "https://e.org/c.png"}),
        ("step", {"name": "3"}, text("do")),
        ("question", {"title": "Why?"}, text("because")),
        ("query", {"text": "list"}),
        ("property-block", {"name": "level", "text": "a: b"}),
        ("property-block", {"name": "level", "text": "later"}),
        ("property-block", {"name": "title", "text": "not mine"}),
        ("unheard", {"text": "nothing"}),
        ("paragraph", {}, ("link-external", {"name": "https://e.org"}), ("term-ref", {"name": "t", "text": "Term"}), ("source-ref", {"name": "b1", "title": "0123456789"}), ("keyboard", {"text": "Esc"}), ("placeholder", {"text": "name"}), ("math-inline", {"text": "y"})),
    ]
    want = HEADER.format("n1", 'level: "a: b"\n') + (
        "\n\n## Head `x`\n\n### deep\n\nA **bold *both***~~gone~~[^1]: see[^2]\n\n```python\nprint(1)\nx\n```\n\n```\nSTOP\n```\n\n$ ls\n$ pwd\n\n$$\ne=mc^2\n$$\n\n$x$\n\n---"
        "\n\n![alt](assets/n1/a/b.png)\n*Cap*\n\n![](https://e.org/c.png)\n\n**Paso 3:** do\n\n**Pregunta:** Why?\n\nbecause\n\n"
        + T.QUERIES + "\n\n" + T.QUERY_NOTE + "\n\n| Query | Resultado |\n|---|---|\n| `list` | " + T.QUERY_ROW + " |"
        "\n\n[https://e.org](https://e.org)[[term:t|Term]]<!-- src: b1 (01234567) -->`Esc`{{name}}$y$\n"
    )
    assert rendered(spark, {"n1": note})["n1"] == want


def test_lists_in_lists_keep_their_columns(spark):
    inner = ("list", {"flag": True}, ("item", {}, text("one"), ("list", {}, ("item", {}, text("deep")))), ("item", {}, text("two")))
    note = [("list", {}, ("item", {}, text("first"), inner), ("item", {}, text("last"))), ("checklist", {}, ("item", {"flag": True}, text("done")), ("item", {}, text("open"), ("list", {}, ("item", {}, text("sub")))))]
    want = "\n\n- first\n  1. one\n     - deep\n  2. two\n- last\n\n- [x] done\n- [ ] open\n  - sub\n"
    assert rendered(spark, {"n": note})["n"] == HEADER.format("n", "") + want


def test_tables_callouts_quotes_and_folds(spark):
    cell = lambda t, span="": ("cell", {"text": t, "name": span})
    grid = (("row", {"flag": True}, cell("A"), cell("B")), ("row", {}, cell("1", "1×2"), cell("")), ("row", {}, cell("2"), ("cell", {}, ("strong", {}, text("b")))))
    note = [
        ("table", {}, *grid),
        ("table", {"name": "merged", "title": "4.1"}, *grid),
        ("admonition", {"name": "danger", "title": "Mind"}, text("one\n\ntwo")),
        ("admonition", {"name": "unheard"}, text("x")),
        ("quote", {"title": "Someone"}, text("said\nit")),
        ("collapsible", {}, ("paragraph", {}, text("p")), ("list", {}, ("item", {}, text("i")))),
        ("columns", {}, ("paragraph", {}, text("left")), ("paragraph", {}), ("paragraph", {}, text("right"))),
    ]
    plain = "| A | B |\n|---|---|\n| 1 |  |\n| 2 | **b** |"
    want = (
        "\n\n" + plain + "\n\n" + plain + "\n\n> ⚠️ **Estructura original con celdas combinadas (2 filas × 2 cols)** — ver fuente §4.1\n\n<details markdown=\"1\">\n<summary>Matriz original con rowspan/colspan (2×2)</summary>\n\n"
        "| Fila | Col | Valor |\n|---|---|---|\n| 0 | 0 | 1 (1×2) |\n| 0 | 1 |  |\n| 1 | 0 | 2 |\n| 1 | 1 | **b** |\n\n</details>"
        "\n\n> [!danger]+ 🚫 Mind {.callout-callout-danger}\n> one\n>\n> two\n\n> [!unheard]+ 📝 {.callout-callout-note}\n> x\n\n> said\n> it\n> — Someone"
        '\n\n<details markdown="1">\n<summary>Detalles</summary>\n\np\n\n- i\n\n</details>\n\nleft\n\nright\n'
    )
    assert rendered(spark, {"n": note})["n"] == HEADER.format("n", "") + want


def test_backlinks_and_empty_notes(spark):
    link = lambda to: ("paragraph", {}, ("strong", {}, ("link-note", {"name": to})))
    got = rendered(spark, {"a": [link("b"), link("b"), link("a")], "c": [link("b")], "b": [("paragraph", {})]})
    assert got["b"] == HEADER.format("b", "") + "\n\n" + T.BACKLINKS + "\n\n- [a](a.md)\n- [c](c.md)\n\n"
    assert got["a"].endswith("\n\n**[b](b.md)**\n\n**[b](b.md)**\n\n**[a](a.md)**\n")
