"""File sources: office and e-book packages, PDF bytes, HTML, note language, Markdown and TeX.

Each reader takes a DataFrame of (path, content) as `spark.read.format("binaryFile")` gives it, or (path, text), and
returns typed rows through Arrow batches; files never pass the driver. Packages are read with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.plans.catalog import engine_table, rows_only

REGION = "path string, ord long, kind string, level int, text string"


def parsed(files: DataFrame, column: str, schema: str, parse: Callable[[str, object], Iterator[tuple]]) -> DataFrame:
    """Rows that parse(path, value) yields, each after its path; a file that cannot be read gives one row of kind `error`."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for path, value in zip(batch["path"], batch[column]):
                if value is None:
                    continue
                try:
                    out += [(path, *row) for row in parse(path, value)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, UnicodeError) as e:
                    out.append((path, 0, "error", *[None] * (len(names) - 4), str(e)[:200]))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", column).mapInPandas(run, schema)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node, name: str) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == name)


def docx_regions(path: str, content: bytes) -> Iterator[tuple]:
    """Styled paragraphs, table rows and comments of a word-processing package."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        ordinal = 0
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
        for node in body:
            if _local(node.tag) == "p":
                style = next((v for s in node.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
                text = _texts(node, "t").strip()
                if text:
                    m = re.match(r"(?i)heading ?(\d)", style)
                    yield ordinal, "heading" if m else "list_item" if style.lower().startswith("list") else "text", int(m[1]) if m else None, text
                    ordinal += 1
            elif _local(node.tag) == "tbl":
                for row in (r for r in node if _local(r.tag) == "tr"):
                    yield ordinal, "table_row", None, " | ".join(_texts(c, "t") for c in row if _local(c.tag) == "tc")
                    ordinal += 1
        if "word/comments.xml" in z.namelist():
            for c in ElementTree.fromstring(z.read("word/comments.xml")):
                yield ordinal, "comment", None, _texts(c, "t")
                ordinal += 1


def pptx_regions(path: str, content: bytes) -> Iterator[tuple]:
    """Title, text and notes of each slide; level is the slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        ordinal = 0
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        for kind, folder in (("text", r"ppt/slides/slide\d+\.xml"), ("notes", r"ppt/notesSlides/notesSlide\d+\.xml")):
            for name in sorted((n for n in z.namelist() if re.fullmatch(folder, n)), key=number):
                for shape in (s for s in ElementTree.fromstring(z.read(name)).iter() if _local(s.tag) == "sp"):
                    text = _texts(shape, "t").strip()
                    title = any(v in ("title", "ctrTitle") for s in shape.iter() if _local(s.tag) == "ph" for v in s.attrib.values())
                    if text:
                        yield ordinal, "heading" if title else kind, number(name), text
                        ordinal += 1


_EPUB_TAGS = re.compile(r"<(h[1-6]|p|li|blockquote|pre|figcaption)\b[^>]*>(.*?)</\1>|<img\b([^>]*)>", re.S | re.I)


def epub_regions(path: str, content: bytes) -> Iterator[tuple]:
    """Regions of the chapters in spine order; level is the heading level or the chapter."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(n.attrib["full-path"] for n in box.iter() if _local(n.tag) == "rootfile")
        root = ElementTree.fromstring(z.read(opf))
        items = {n.attrib["id"]: n.attrib["href"] for n in root.iter() if _local(n.tag) == "item"}
        base = opf.rpartition("/")[0]
        ordinal = 0
        for chapter, ref in enumerate((n.attrib["idref"] for n in root.iter() if _local(n.tag) == "itemref"), 1):
            html = z.read(f"{base}/{items[ref]}" if base else items[ref]).decode("utf-8", "replace")
            for m in _EPUB_TAGS.finditer(html):
                if m[3] is not None:
                    yield ordinal, "figure", chapter, "".join(re.findall(r'src="([^"]*)"', m[3])[:1])
                else:
                    text = " ".join(unescape(re.sub(r"<[^>]+>", " ", m[2])).split())
                    if not text:
                        continue
                    tag = m[1].lower()
                    yield ordinal, "heading" if tag[0] == "h" else {"li": "list_item", "blockquote": "quote", "pre": "code"}.get(tag, "text"), int(tag[1]) if tag[0] == "h" else chapter, text
                ordinal += 1


def pdf_page_metrics(path: str, content: bytes) -> Iterator[tuple]:
    """Text length of each page by the page markers and text operators of uncompressed PDF bytes; level is the image count."""
    starts = [m.start() for m in re.finditer(rb"/Type\s*/Page(?![A-Za-z])", content)]
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(content)])):
        chunk = content[a:b]
        shown = b"".join(s[1:-1] for block in re.findall(rb"BT\s(.*?)\sET", chunk, re.S) for s in re.findall(rb"\((?:[^\\()]|\\.)*\)(?=\s*Tj)", block))
        yield i, "page", len(re.findall(rb"/Subtype\s*/Image", chunk)), shown.decode("latin-1")


class _Cleaner(HTMLParser):
    """Main text and headings with a proper stack: <main>, else <article>, else <body>."""

    SKIPPED = frozenset("nav aside header footer script style noscript form button".split())
    NAMES = frozenset("nav navbar menu sidebar footer header breadcrumb breadcrumbs cookie cookies banner ad ads promo toc".split())
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol table tr td th pre blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.rows: list[tuple[str, int | None, str, frozenset]] = []
        self.buffer: list[str] = []
        self.meta: list[tuple[str, str]] = []
        self.title: list[str] = []

    def _flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            tags = [t for t, _ in self.stack]
            head = next((t for t in reversed(tags) if re.fullmatch("h[1-6]", t)), None)
            self.rows.append(("heading" if head else "text", int(head[1]) if head else None, text, frozenset(tags)))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in self.BLOCK:
            self._flush()
            if any(t == "p" for t, _ in self.stack):
                self._pop("p")
        if tag == "link" and a.get("rel") == "canonical":
            self.meta.append(("canonical", a.get("href", "")))
        if tag == "meta" and a.get("name") in ("product", "version"):
            self.meta.append((a["name"], a.get("content", "")))
        if tag == "a" and a.get("href"):
            self.meta.append(("link", a["href"]))
        if tag in self.VOID:
            self.buffer.append(" ")
            return
        names = set(re.split(r"[^a-z]+", " ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""))).lower()))
        self.stack.append((tag, tag in self.SKIPPED or bool(names & self.NAMES)))

    def _pop(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._flush()
                del self.stack[i:]
                return

    def handle_endtag(self, tag):
        self._pop(tag)

    def handle_data(self, data):
        if any(t == "title" for t, _ in self.stack):
            self.title.append(data)
        elif not any(skip for _, skip in self.stack):
            self.buffer.append(data)


def html_clean(path: str, text: str) -> Iterator[tuple]:
    """Title, headings, main text blocks, canonical link, product and version, and links."""
    c = _Cleaner()
    c.feed(text)
    c.close()
    c._flush()
    home = next((t for t in ("main", "article", "body") if any(t in r[3] for r in c.rows)), None)
    ordinal = 0
    for kind, level, value in [("title", None, " ".join("".join(c.title).split())), *((k, lv, v) for k, lv, v, tags in c.rows if home is None or home in tags), *((k, None, v) for k, v in c.meta)]:
        yield ordinal, kind, level, value
        ordinal += 1


# Fixed values of the note language: its directives and the forms of its lines.
DIRECTIVES = frozenset("warning note tip example danger security performance version deprecated conflict external derived collapsible columns param-table step question diagram figure equation console property".split())
_OPEN = re.compile(r":::([a-z][a-z0-9-]*)(?:\s+(.+))?")
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"```(\w*)")
_ITEM = re.compile(r"(\s*)([-*+]|\d+\.)\s+(.+)")
_TABLE_RULE = re.compile(r"\|?(\s*:?-{3,}:?\s*\|?)+")


def notemark_nodes(path: str, text: str) -> Iterator[tuple]:
    """Flattened nodes of a note; level is the heading level, list depth or directive depth; errors are rows of kind `error`."""
    rows: list[tuple] = []
    open_directives: list[tuple[str, int]] = []
    fence: list[str] | None = None
    header = False
    paragraph: list[str] = []

    def put(kind, level, value):
        rows.append((len(rows), kind, level, value))

    def end_paragraph():
        if paragraph:
            put("paragraph", len(open_directives), " ".join(paragraph))
            paragraph.clear()

    for number, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if fence is not None:
            if bare == "```":
                put("code", len(open_directives), "\n".join(fence))
                fence = None
            else:
                fence.append(line)
            continue
        if bare == "---" and (number == 1 or header):
            header = number == 1
            continue
        if header:
            key, _, value = line.partition(":")
            put("property", None, f"{key.strip()}={value.strip()}")
            continue
        structural = None
        if m := _FENCE.fullmatch(bare):
            structural, fence = True, []
        elif m := _OPEN.fullmatch(bare):
            end_paragraph()
            put("directive" if m[1] in DIRECTIVES else "error", len(open_directives), m[1])
            open_directives.append((m[1], number))
            structural = True
        elif bare == ":::":
            end_paragraph()
            if open_directives:
                open_directives.pop()
            else:
                put("error", None, f"line {number}: nothing to close")
            structural = True
        if structural:
            end_paragraph()
            continue
        if not bare:
            end_paragraph()
        elif m := _HEADING.fullmatch(bare):
            end_paragraph()
            put("heading", len(m[1]), m[2].strip())
        elif m := _ITEM.fullmatch(line):
            end_paragraph()
            put("ordered_item" if m[2][0].isdigit() else "bullet", len(m[1]) // 2, m[3])
        elif "|" in line and number > 1:
            end_paragraph()
            if not _TABLE_RULE.fullmatch(bare):
                put("table_row", None, bare)
        elif bare.startswith(">"):
            end_paragraph()
            put("quote", None, bare[1:].strip())
        else:
            paragraph.append(bare)
    end_paragraph()
    for name, number in open_directives:
        put("error", None, f"line {number}: {name} is not closed")
    if fence is not None:
        put("error", None, "code is not closed")
    yield from rows


def markdown_blocks(path: str, text: str) -> Iterator[tuple]:
    """Blocks of a Markdown render, the reverse of `rnd_markdown`."""
    for ordinal, part in enumerate(p for p in re.split(r"\n{2,}", text) if p.strip()):
        if m := re.match(r"(#{1,6}) (.*)", part, re.S):
            yield ordinal, "heading", len(m[1]), m[2]
        elif part.startswith("- "):
            yield ordinal, "bullet", None, part[2:]
        elif part.startswith("> "):
            yield ordinal, "callout", None, part[2:]
        else:
            yield ordinal, "paragraph", None, part


_TEX_ENV = re.compile(r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|theorem|lemma|proposition|corollary|definition|proof|algorithm|tabular)\}(?:\[([^\]]*)\])?(.*?)\\end\{\1\}|\$\$(.+?)\$\$|\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}", re.S)
_TEX_MACRO = re.compile(r"\\(?:re)?newcommand\*?\{?\\([A-Za-z]+)\}?(?:\[(\d)\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_NUMBERED = frozenset("equation align gather multline".split())


def tex_macros(text: str) -> dict[str, tuple[int, str]]:
    return {m[1]: (int(m[2] or 0), m[3]) for m in _TEX_MACRO.finditer(text)}


def expand_macros(latex: str, macros: dict[str, tuple[int, str]], depth: int = 5) -> str:
    """Macros replaced, at most `depth` rounds."""
    for _ in range(depth):
        before = latex
        for name, (n, body) in macros.items():
            call = re.compile(r"\\" + name + r"(?![A-Za-z])" + r"\{([^{}]*)\}" * n)
            latex = call.sub(lambda m, body=body: re.sub(r"#(\d)", lambda d: m[int(d[1])], body), latex)
        if latex == before:
            break
    return latex


def tex_flat(main: str, files: dict[str, str], seen: frozenset = frozenset()) -> str:
    """A main file without comments, with its inputs in place; an input that is open already is left out."""
    text = re.sub(r"(?<!\\)%.*", "", files.get(main, ""))

    def put(m):
        name = m[1] if m[1].endswith(".tex") else m[1] + ".tex"
        return "" if name in seen or name == main else tex_flat(name, files, seen | {main})

    return re.sub(r"\\(?:input|include)\{([^}]*)\}", put, text)


def tex_environments(path: str, text: str) -> Iterator[tuple]:
    """Equations with their numbers, theorems, proofs, algorithms, tables and bibliography; level is the equation number."""
    macros, number = tex_macros(text), 0
    for ordinal, m in enumerate(_TEX_ENV.finditer(text)):
        env, body = m[1] or ("$$" if m[4] else "bibitem"), m[3] or m[4] or m[5] or ""
        tag = re.search(r"\\tag\{([^}]*)\}", body)
        if env in _NUMBERED and not tag:
            number += 1
        clean = re.sub(r"\\(?:label|tag)\{[^}]*\}|\\nonumber\b", "", body)
        yield ordinal, env, number if env in _NUMBERED and not tag else None, re.sub(r"\s+", " ", expand_macros(clean, macros)).strip()


# Queries: files are made from the driver's tables inside the tasks, then read back.


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def _made(docs: DataFrame, build: Callable[[str], bytes]) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [build(t) for t in batch["text"]]})

    return docs.mapInPandas(run, "path string, content binary")


def _package(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _xml(text: str) -> str:
    clean = re.sub(r"[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", " ", text)
    return clean.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def make_docx(text: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    paragraphs = "".join(f'<w:p><w:pPr><w:pStyle w:val="{"Heading1" if i == 0 else "Normal"}"/></w:pPr><w:r><w:t>{_xml(x)}</w:t></w:r></w:p>' for i, x in enumerate(text.split("\n")))
    return _package({"word/document.xml": f"<w:document {w}><w:body>{paragraphs}</w:body></w:document>"})


def make_pptx(text: str) -> bytes:
    names = 'xmlns:p="urn:p" xmlns:a="urn:a"'
    shape = lambda x, ph: f"<p:sp><p:nvSpPr>{ph}</p:nvSpPr><p:txBody><a:p><a:r><a:t>{_xml(x)}</a:t></a:r></a:p></p:txBody></p:sp>"
    return _package({f"ppt/slides/slide{i}.xml": f'<p:sld {names}>{shape(x, chr(60) + "p:ph type=" + chr(34) + "title" + chr(34) + "/>" if i == 1 else "")}</p:sld>' for i, x in enumerate(text.split("\n"), 1)})


def make_epub(text: str) -> bytes:
    body = "".join(f"<{'h1' if i == 0 else 'p'}>{_xml(x)}</{'h1' if i == 0 else 'p'}>" for i, x in enumerate(text.split("\n")))
    return _package({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": '<package><manifest><item id="c1" href="c1.xhtml"/></manifest><spine><itemref idref="c1"/></spine></package>', "OPS/c1.xhtml": f"<html><body>{body}</body></html>"})


def make_pdf(text: str) -> bytes:
    pages = []
    for line in text.split("\n"):
        shown = line.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        pages.append(b"<< /Type /Page >>\nBT (" + shown + b") Tj ET\n")
    return b"%PDF-1.4\n" + b"".join(pages)


@rows_only("src_docx")
def src_docx(spark, sf_dir):
    return parsed(_made(_docs(spark, sf_dir), make_docx), "content", REGION, docx_regions)


@rows_only("src_pptx")
def src_pptx(spark, sf_dir):
    return parsed(_made(_docs(spark, sf_dir), make_pptx), "content", REGION, pptx_regions)


@rows_only("src_epub")
def src_epub(spark, sf_dir):
    return parsed(_made(_docs(spark, sf_dir), make_epub), "content", REGION, epub_regions)


@rows_only("src_pdf_bytes")
def src_pdf_bytes(spark, sf_dir):
    return parsed(_made(_docs(spark, sf_dir), make_pdf), "content", REGION, pdf_page_metrics)


@rows_only("src_html_clean")
def src_html_clean(spark, sf_dir):
    return parsed(engine_table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")), "text", REGION, html_clean)


@rows_only("src_notemark")
def src_notemark(spark, sf_dir):
    lines = F.concat(F.lit("---\ntitle: x\n---\n:::note\n"), F.col("text"), F.lit("\n:::\n- item\n"))
    return parsed(_docs(spark, sf_dir).withColumn("text", lines), "text", REGION, notemark_nodes)


@rows_only("src_markdown_reverse")
def src_markdown_reverse(spark, sf_dir):
    from corpusflow.plans.registry import QUERIES

    notes = QUERIES["rnd_markdown"](spark, sf_dir)
    return parsed(notes.select(F.col("note_id").alias("path"), "text"), "text", REGION, markdown_blocks)


def _tex(spark, sf_dir):
    body = F.concat(F.lit("\\newcommand{\\vect}[1]{\\mathbf{#1}}\n"), F.regexp_replace("text", "[\\\\%{}]", ""), F.lit("\n\\begin{equation}\\label{e} a = \\vect{x} \\end{equation} % note\n\\begin{theorem}[T] Let. \\end{theorem}\n$$b$$\n\\bibitem{k}"))
    return _docs(spark, sf_dir).withColumn("text", body)


@rows_only("fn_tex_env")
def fn_tex_env(spark, sf_dir):
    return parsed(_tex(spark, sf_dir), "text", REGION, tex_environments)


@rows_only("fn_tex_macros")
def fn_tex_macros(spark, sf_dir):
    return parsed(_tex(spark, sf_dir), "text", REGION, lambda path, text: ((i, k, n, body) for i, (k, (n, body)) in enumerate(tex_macros(text).items())))


@rows_only("src_tex_tree")
def src_tex_tree(spark, sf_dir):
    return parsed(_tex(spark, sf_dir), "text", REGION, lambda path, text: [(0, "flat", None, tex_flat("main.tex", {"main.tex": "\\input{body}", "body.tex": text}))])
