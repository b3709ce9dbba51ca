"""Subtitles, headers, sections and attributes on files written by hand."""

from __future__ import annotations

from corpusflow.plans import registry
from corpusflow.plans.catalog import apply

registry.load()

SRT = """

1
00:00:01,500 --> 00:00:02,000
Um, hello
there

2
00:00:03,000 --> 00:00:04,250
uh, no pause before this

oops
not a time --> at all

4
01:02:06,001 --> 01:02:07,000
Um,  uh-huh er so um yes

5
01:02:10,000 --> 01:02:11,000
"""
VTT = """WEBVTT Kind: captions

NOTE 00:00:00.000 is a time

00:00:05.000 --> 00:00:06.500
mm-hmm mmm fine

intro
00:00:07.000-->00:00:08.000
Hmm
"""


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "conv_id long, content string")


def test_srt(spark):
    got = [(r.cue, r.start_s, r.end_s, r.text) for r in apply("src_srt", srt_files=files(spark, SRT, None, "")).orderBy("conv_id", "cue").collect()]
    assert got == [(1, 1.5, 2.0, "Um, hello there"), (2, 3.0, 4.25, "uh, no pause before this"), (3, 3726.001, 3727.0, "so um yes"), (4, 3730.0, 3731.0, "")]


def test_vtt(spark):
    got = [(r.cue, r.start_s, r.end_s, r.text) for r in apply("src_vtt", vtt_files=files(spark, VTT)).orderBy("cue").collect()]
    assert got == [(1, 5.0, 6.5, "mmm fine"), (2, 7.0, 8.0, "Hmm")]


def test_headers(spark):
    text = '---\ntitle: "A: b"\ncount: -3\nshare: 0.5\ndone: true\nnone: ~\nempty:\ntags:\n  - x\n  - "y, z"\n# remark: none\nnote-type: concept\n---\nlater: no\n---\n'
    df = spark.createDataFrame([("n", text), ("m", "no header"), ("o", None)], "note_id string, text string")
    got = {r.key: (r.value, r.kind) for r in apply("fn_frontmatter", header_files=df).collect()}
    assert got == {"title": ("A: b", "text"), "count": ("-3", "int"), "share": ("0.5", "float"), "done": ("true", "bool"), "none": (None, "null"), "empty": (None, "null"), "tags": ("x|y, z", "list"), "note-type": ("concept", "text")}


def test_sections(spark):
    lines = ["before", "## One", "", "a", "### Two  ", "b", "c", "####### no heading", "# Three"]
    df = spark.createDataFrame([("n", i, t) for i, t in enumerate(lines)], "note_id string, ord long, line string")
    got = [(r.part, r.heading, r.level, r.body) for r in apply("fn_section_extract", note_lines=df).orderBy("part").collect()]
    assert got == [(1, "One", 2, "a"), (2, "Two", 3, "b\nc\n####### no heading"), (3, "Three", 1, "")]


def test_attributes(spark):
    df = spark.createDataFrame([(1, '<p class="a b" id=x data-n="1">k=v</p><br><a href="u?q=1&amp;r=2">'), (2, "none"), (3, None)], "page_id long, html string")
    got = [(r.page_id, r.place, r.key, r.value) for r in apply("fn_attrs", pages=df).orderBy("place").collect()]
    assert got == [(1, 1, "class", "a b"), (1, 2, "id", "x"), (1, 3, "data-n", "1"), (1, 4, "href", "u?q=1&amp;r=2")]
