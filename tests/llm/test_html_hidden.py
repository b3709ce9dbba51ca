"""What hides an element of a page."""

from __future__ import annotations

import pytest

from corpusflow.llm import html_extraction


@pytest.mark.parametrize("attributes", ['class="prose overflow-hidden"', 'title="The hidden valley"', 'hidden="false"', 'data-hidden="x"', 'aria-hidden="false"', 'title="display:none"', 'class="a hidden"'])
def test_words_in_values_hide_nothing(attributes):
    assert [b.text for b in html_extraction.leaf_blocks(f"<article {attributes}><p>Main text</p></article>")] == ["Main text"]


@pytest.mark.parametrize("attributes", ["hidden", 'class="x" HIDDEN', 'hidden=""', "hidden='until-found'", 'style="color:red; display : none"', "aria-hidden=true", 'title="a" aria-hidden="true"'])
def test_hiding_attributes(attributes):
    assert [b.text for b in html_extraction.leaf_blocks(f"<div {attributes}><p>Off</p></div><p>On</p>")] == ["On"]
