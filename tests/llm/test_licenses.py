"""Licences as they are published: wrapped, bulleted, titled, and with lines about holders around them."""

from __future__ import annotations

import textwrap

import pytest

from corpusflow.llm import license_scan as L

ISC = """ISC License

Copyright (c) 2004-2010 by Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + L.TEXTS["ISC"].split("\n\n")[1]
BSD = "Copyright 2019, A. Holder\nAll rights reserved.\n\n" + L.TEXTS["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")
WRAPPED = {name: "\n\n".join(textwrap.fill(p, 70) for p in text.split("\n\n")) for name, text in L.TEXTS.items()}


@pytest.mark.parametrize(
    "text,license,whole",
    [
        (ISC, "ISC", True),
        (BSD, "BSD-2-Clause", True),
        *((t, n, True) for n, t in WRAPPED.items()),
        ("The MIT License (MIT)\n\nCopyright © 2015 X\n\n" + WRAPPED["MIT"], "MIT", True),
        ("The MIT License\n\n" + WRAPPED["MIT"] + "\n\nAll rights reserved.", "MIT", True),
        ('Licensed under the Apache License, Version 2.0 (the "License");', "Apache-2.0", True),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0", True),
        ("code\n// SPDX-License-Identifier: GPL-2.0-only\ncode", "GPL-2.0", False),
        ("Copyright (c) 2020 X, licensed under the MIT License.", "MIT", True),
        ("Copyright notice: this file is licensed under the MIT License.", "", False),
        (WRAPPED["MIT"].replace("free of charge", "at a price"), "", False),
    ],
)
def test_published_forms(spark, text, license, whole):
    row = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.licenses, row.whole_text) == (license, whole)


def test_known_texts_hold_a_mark_and_are_stable():
    assert L.canonical_text("x copyright holders and\ncopyright notice, this list") == "x copyright holders and copyright notice this list"
    assert len({d for d, *_ in L.known()}) == len(L.known())
