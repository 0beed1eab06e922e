"""Legal texts made to be slow: each is handled whole, in seconds."""

from __future__ import annotations

import time

import pytest

from sourcegauge.llm import html, licenses, pii, quality

N = 1_000_000
LINES = {
    "labels": "abcdefg› " * (N // 9), "bars": "a|" * (N // 2), "no bars": "a" * N, "blanks": "home" + " " * N + "x", "shouts": "!" * N + "x",
    "zeros": "0" * N + ".1.1.1", "dots": "1." * (N // 2), "digits": "1 " * (N // 2), "ats": "a@" * (N // 2), "pluses": "+1 " * (N // 3), "cues": "password=" * (N // 9),
    "licences": "mit license " * (N // 12), "words": "w " * (N // 2), "schemes": "://a:b" * (N // 6),
}
PAGES = {"unopened": "<i>" * 50_000 + "</u>" * 50_000, "nested": '<div class="x">' * 50_000 + "x", "quotes": '<a "' * 100_001 + ">", "names": "<a" * 200_000,
         "bangs": "<!" * 200_000, "scripts": "<script>" + "</script" * 50_000, "cells": "<p><td>" + "<i>" * 50_000 + "<h1>a</h1>" * 50_000}


def test_lines(spark):
    rows = list(LINES.items())
    start = time.time()
    got = {r.doc_id: r for r in quality.measure(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).drop("clean_text").collect()}
    assert time.time() - start < 240
    assert (got["labels"].n_bad_lines, got["bars"].n_bad_lines, got["no bars"].n_bad_lines, got["blanks"].n_bad_lines, got["shouts"].n_bad_lines) == (1, 1, 0, 0, 0)
    assert got["words"].n_words == N // 2 == got["words"].n_repeat_words


@pytest.mark.parametrize("name", LINES)
def test_personal_data_and_licences(name):
    start, automaton, text = time.time(), pii.anchors(), LINES[name]
    found = pii.find(text, automaton)
    assert len(licenses.Scanner().scan(text)["found"]) >= (N // 12 if name == "licences" else 0)
    assert time.time() - start < 30
    assert [s for s in found if s[1] == "ip"] == {"zeros": [(0, "ip", N + 6)], "dots": [(8 * i, "ip", 8 * i + 7) for i in range(N // 8)]}.get(name, [])


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    start = time.time()
    html.main_text(PAGES[name], {})
    assert time.time() - start < 20


def test_several_articles():
    page = "<nav>menu</nav><article><h1>One</h1><p>first text</p></article><aside>ad</aside><article><p>second</p></article><footer>f</footer>"
    assert html.main_text(page, {}) == "One\nfirst text\nsecond"
