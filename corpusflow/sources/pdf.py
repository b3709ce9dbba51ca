"""PDF text fragments and outlines with the standard library.

Objects are found by their markers, Flate streams are inflated, and the text operators of each page's content give fragments
with place, font and size. Object streams, encryption and font encodings other than Latin-1 are beyond it: such a page
gives no fragments. A PDF library can be put in its place behind the same schema.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from corpusflow.plans.catalog import rows_only
from corpusflow.sources import files

FRAGMENT = "path string, ord long, kind string, page int, x double, y double, font string, size double, text string"
OUTLINE = "path string, ord long, kind string, level int, section_path string, title string"
_OBJECT = re.compile(rb"(\d+)\s+0\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"/([A-Za-z0-9+\-_.]+)\s+(-?[\d.]+)\s+Tf|(-?[\d.]+)\s+(-?[\d.]+)\s+T[dD]|((?:-?[\d.]+\s+){6})Tm|(\((?:[^\\()]|\\.)*\))\s*(?:Tj|')|\[((?:\((?:[^\\()]|\\.)*\)|[^\]])*)\]\s*TJ|\b(BT)\b", re.S)
_STRING = re.compile(rb"\((?:[^\\()]|\\.)*\)", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(.))", re.S)


def _text(raw: bytes) -> str:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(m[2], m[2]), raw[1:-1]).decode("latin-1")


def objects(content: bytes) -> dict[int, bytes]:
    return {int(m[1]): m[2] for m in _OBJECT.finditer(content)}


def _stream(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" not in body[: m.start()]:
        return m[1]
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return b""


def _pages(found: dict[int, bytes]) -> list[bytes]:
    return [b for _, b in sorted(found.items()) if re.search(rb"/Type\s*/Page(?![A-Za-z])", b)]


def fragments(path: str, content: bytes) -> Iterator[tuple]:
    """Each shown string with its page, place, font and size."""
    found, ordinal = objects(content), 0
    for page, body in enumerate(_pages(found), 1):
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+0\s+R)", body)
        code = b"\n".join(_stream(found.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+0\s+R", refs[1])) if refs else b""
        font, size, x, y = "", 0.0, 0.0, 0.0
        for m in _TOKEN.finditer(code):
            if m[8]:
                x = y = 0.0
            elif m[1]:
                font, size = m[1].decode(), float(m[2])
            elif m[3]:
                x, y = x + float(m[3]), y + float(m[4])
            elif m[5]:
                x, y = (float(v) for v in m[5].split()[4:6])
            else:
                text = _text(m[6]) if m[6] else "".join(_text(s) for s in _STRING.findall(m[7]))
                if text.strip():
                    yield ordinal, "fragment", page, x, y, font, size, text
                    ordinal += 1


def outline(path: str, content: bytes) -> Iterator[tuple]:
    """The bookmark tree, depth first; a slug that comes again under its parent gets -2, -3."""
    found = objects(content)
    root = next((b for b in found.values() if re.search(rb"/Type\s*/Outlines\b", b)), None)
    link = lambda body, name: int(m[1]) if (m := re.search(rb"/" + name + rb"\s+(\d+)\s+0\s+R", body)) else None
    rows: list[tuple] = []
    seen: set[int] = set()

    def walk(number: int | None, level: int, parent: str):
        used: dict[str, int] = {}
        while number in found and number not in seen:
            seen.add(number)
            body = found[number]
            title = re.search(rb"/Title\s*(\((?:[^\\()]|\\.)*\))", body, re.S)
            name = _text(title[1]) if title else ""
            slug = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "section"
            used[slug] = used.get(slug, 0) + 1
            here = f"{parent}/{slug}" + (f"-{used[slug]}" if used[slug] > 1 else "")
            rows.append((len(rows), "outline", level, here, name))
            walk(link(body, b"First"), level + 1, here)
            number = link(body, b"Next")

    if root:
        walk(link(root, b"First"), 1, "")
    yield from rows


def make_pdf(text: str) -> bytes:
    """A PDF with a page and a bookmark for each line; for queries and tests."""
    lines = text.split("\n")
    escape = lambda s: s.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    body = [b"%PDF-1.4\n1 0 obj\n<< /Type /Outlines /First 1000000 0 R >>\nendobj\n"]
    for i, line in enumerate(lines):
        code = zlib.compress(b"BT /F%d %d Tf 72 %d Td (" % (i % 2, 18 if i == 0 else 10, 700 - i % 40) + escape(line) + b") Tj ET")
        body.append(b"%d 0 obj\n<< /Type /Page /Contents %d 0 R >>\nendobj\n" % (10 + 2 * i, 11 + 2 * i))
        body.append(b"%d 0 obj\n<< /Filter /FlateDecode /Length %d >>\nstream\n" % (11 + 2 * i, len(code)) + code + b"\nendstream\nendobj\n")
        body.append(b"%d 0 obj\n<< /Title (" % (1_000_000 + i) + escape(line[:40]) + b")" + (b" /Next %d 0 R" % (1_000_001 + i) if i + 1 < len(lines) else b"") + b" >>\nendobj\n")
    return b"".join(body)


@rows_only("src_pdf_fragments")
def src_pdf_fragments(spark, sf_dir):
    return files.parsed(files._made(files._docs(spark, sf_dir), make_pdf), "content", FRAGMENT, fragments)


@rows_only("src_pdf_outline")
def src_pdf_outline(spark, sf_dir):
    return files.parsed(files._made(files._docs(spark, sf_dir), make_pdf), "content", OUTLINE, outline)
