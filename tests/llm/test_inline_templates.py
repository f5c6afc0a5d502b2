"""Passages that run across inline templates."""

import pytest

from statelog.llm.leaks import LeakFinder

ITEM = "one two three four five six seven eight mot ten eleven twelve thirteen fourteen"


@pytest.mark.parametrize("page", [
    "one two three four five six seven eight {{lang|fr|mot}} ten eleven twelve thirteen fourteen",
    "x {{quote|one two three four five six seven eight {{lang|fr|mot}} ten eleven twelve thirteen fourteen}} y",
    "x {{quote|text=one two three four five six seven eight {{lang|fr|{{nobold|mot|style=x}}}} ten eleven twelve thirteen fourteen|by=z}} y",
])
def test_passage_across_a_template(page):
    assert LeakFinder([(1, ITEM)]).leaks(page) == {1: 14}


def test_other_words_are_no_leak():
    assert LeakFinder([(1, ITEM)]).leaks("one two three four five six seven eight {{lang|mot|other}} ten eleven twelve thirteen fourteen") == {}
