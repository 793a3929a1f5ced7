"""Pages: block rules one by one, names, hostile markup in linear time, character references, odd columns."""

import time

import pytest

from brindle.llm import language, pages

GOOD = "The cat and the dog are in the house of a man, and it is on the hill by the sea for all of that time."
POOR = "Quartz sphinx vexed brightly zigzag pyjamas jumbled fjords waltz bewildering nymph kvetch quickly."


def test_stop_word_share_decides_long_blocks():
    assert GOOD in pages.main_text(f"<p>{GOOD}</p>")
    # long without stop words is open, and no neighbour decides it
    assert pages.main_text(f"<p>{POOR}</p>") == ""
    assert pages.main_text(f"<p>{GOOD}</p><p>{POOR}</p>") == f"{GOOD}\n\n{POOR}"


def test_link_share_decides_blocks():
    half = len(GOOD) // 2
    assert pages.main_text(f"<p><a href=x>{GOOD}</a></p>") == ""
    assert pages.main_text(f"<p><a href=x>{GOOD[: half - 5]}</a>{GOOD[half - 5 :]}</p>") == GOOD
    assert pages.main_text(f"<p><a href=x>{GOOD[: half + 8]}</a>{GOOD[half + 8 :]}</p>") == ""


def test_open_blocks_follow_their_nearest_neighbours():
    good, bad = f"<p>{GOOD}</p>", f"<p><a href=x>{GOOD}</a></p>"
    text = lambda *parts: pages.main_text("".join(parts)).split("\n\n")
    assert text(good, "<p>Zip one</p>", "<p>Zip two</p>", bad) == [GOOD, "Zip one"]
    assert text(bad, "<p>Zip one</p>", "<p>Zip two</p>", good) == ["Zip two", GOOD]
    # equally near: the section's own label, by a stop word outside articles, always in one
    assert text(good, "<p>Zip</p>", bad) == [GOOD] and text(good, "<p>by Zip</p>", bad) == [GOOD, "by Zip"]
    assert text("<article>", good, "<p>Zip</p>", bad, "</article>") == [GOOD, "Zip"]
    # a neighbour in another section doesn't count
    assert text(f"<div>{good}</div><div class='menu'>", "<p>Zip</p>", "</div>") == [GOOD]


@pytest.mark.parametrize(
    ("name", "kept"),
    [
        ("sponsored-content", False), ("user-comments", False), ("commentlist", False), ("advert-slot-3", False), ("comments-open", True),
        ("no-comments", True), ("commentary", True), ("with-sponsors", True), ("promo-content", False), ("story", True),
    ],
)
def test_names(name, kept):
    page = f'<article><p>{GOOD}</p><div class="{name}"><p>{GOOD} Extra.</p></div></article>'
    assert ("Extra" in pages.main_text(page)) == kept


FORMS = {
    "unclosed": "<blockquote>", "items": "<li><div>" + "<blockquote>" * 10 + "</li>", "list": "<li><blockquote>", "cells": "<tr><td>",
    "closing": "<blockquote></li></ul></div>", "raw": "</script ", "quote": "<a b=\"", "reference": "&#9",
}


@pytest.mark.parametrize("form", FORMS)
def test_hostile_pages_take_linear_time(form):
    """Four times the page takes about four times as long, not sixteen."""
    part, before = FORMS[form], "<script>" if form == "raw" else "<ul><table>"

    def seconds(size):
        page = before + part * (size // len(part))
        best = 1e9
        for _ in range(2):
            begin = time.perf_counter()
            pages.main_text(page)
            best = min(best, time.perf_counter() - begin)
        return best

    assert seconds(1_000_000) < max(9 * seconds(250_000), 0.2)


def test_character_references():
    huge = "9" * 6000
    assert pages.main_text(f"<p>{GOOD} &#{huge}; &#{'0' * 6000}65; &#x{'f' * 99}; &#x41; &amp; &nope;</p>") == f"{GOOD} � A � A & &nope;"


def test_clashing_columns_and_repeated_pages(spark):
    rows = [(1, "u", f"<p>{GOOD}</p>", "old", 5), (1, "u", f"<p>{GOOD}</p>", "old", 6), (2, None, None, None, None), (None, "u", "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in pages.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", GOOD, len(GOOD))] * 2 + [(2, None, "", 0), (None, "u", "", 0)], key=repr)


def test_unlabelled_corpora_are_kept(spark, odd, empty):
    unlabelled = odd.withColumn("lang", odd["lang"].substr(1, 0)).filter("lang is null")
    kept = language.keep_identified(odd, unlabelled.filter("false"))
    assert kept.columns == odd.columns
    want = [r for r in odd.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    assert kept.count() == len(want) > 0
    assert language.keep_identified(empty, empty).count() == 0


def test_very_many_labels_share_a_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "ALL_CHARS", 600)
    rows = [(i, f"word{i} " * 50, f"l{i % 30}") for i in range(90)]
    found = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(found) == 30 and max(map(len, found.values())) <= 20
