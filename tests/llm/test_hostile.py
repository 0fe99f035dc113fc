"""Texts and pages made to stall or crash a parser: each costs about its length."""

import time

import pytest

from traceloom.llm import html_text, quotations


def linked(spark, rows):
    out = quotations.link(spark, spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    return {(r["conv_id"], r["turn"]): r for r in out}


def test_very_many_quote_marks(spark):
    marks = ">" * 100_000
    by = linked(spark, [("c", 0, "a", "said"), ("c", 1, "b", f"{marks}\n> said\nanswer"), ("c", 2, "b", " > " * 20_000 + "deep")])
    assert by["c", 1]["text"] == "answer" and by["c", 1]["parent_turn"] == 0 and by["c", 1]["max_level"] == 1
    assert by["c", 2]["max_level"] == 20_000 and by["c", 2]["text"] == ""


def test_very_long_white_space(spark):
    began = time.perf_counter()
    blank = " \t" * 500_000
    by = linked(spark, [("c", 0, "a", f"  one{blank}two{blank}"), ("c", 1, "b", f"> one two\n{blank}x{blank}y\n"), ("c", 2, "b", f"> one{blank}two\nOn Monday{blank}, A wrote:{blank}\n>> q\nz")])
    assert by["c", 0]["text"] == f"one{blank}two" and by["c", 1]["parent_turn"] == 0 and by["c", 2]["parent_turn"] == 0
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "</x>" * 30_000 + "end", "<b>" * 30_000 + "</i>" * 30_000 + "end", "<p>end" + "<!" * 100_000, "<a " * 30_000 + "end", "<p " + "a='" * 50_000 + "end", "<ul><li>" * 10_000 + "end" + "<li>" * 10_000, "<table><tr><td>" * 5_000 + "end" + "<td>" * 5_000 + "<script>" * 20_000])
def test_hostile_markup_is_read_in_its_length(page):
    began = time.perf_counter()
    assert html_text.main_text(page) in ("end", "")
    assert time.perf_counter() - began < 5


def paragraphs(n, what="a good deal of running text about the matter, and no link at all in it, only words"):
    return "".join(f"<p>Paragraph {k} has {what}.</p>" for k in range(n))


@pytest.mark.parametrize("name", ["post-body social-science", "social-science", "entry legal-history", "menu-planning", "story sharing", "content-with-sidebar", "side-effects"])
def test_a_subject_in_a_name_does_not_cut_the_article(name):
    page = f'<html><title>T</title><body><div class="{name}">{paragraphs(3)}</div><div><p>Short and apart.</p></div></body></html>'
    text = html_text.main_text(page)
    assert [f"Paragraph {k} has" in text for k in range(3)] == [True] * 3 and "<" not in text


@pytest.mark.parametrize("name", ["social-links", "comment-thread", "ad-leaderboard", "newsletter-cta", "related-posts", "SideBar", "share", "cookieNotice", "legal notice"])
def test_names_of_parts_cut_them(name):
    page = f'<body><div class="content">{paragraphs(3)}<div class="{name}">{paragraphs(1, "what is beside the article")}</div></div></body>'
    assert "beside" not in html_text.main_text(page)


def test_menus_in_main_are_left_out():
    menu = "".join(f'<a href="/{k}">Link {k}</a> ' for k in range(9))
    text = html_text.main_text(f"<main><div>{menu}</div><h1>Title</h1><div>{paragraphs(4)}</div></main>")
    assert "Link" not in text and text.startswith("Title\nParagraph 0") and "Paragraph 3" in text
    assert "a link" in html_text.main_text(f'<main>{paragraphs(4)}<p>with <a href="x">a link</a></p></main>')
