"""Wrapped, deep and oddly named pages, and pages without an article element."""

import time

import pytest

from stripweave.llm import wrapper_html


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in wrapper_html.main_text(frame).collect()}


def words(name, n):
    return " ".join(f"{name}x{k}" for k in range(n))


def test_form_round_the_page(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><form id=f><nav>Home</nav><article><p>{words(f'a{i}', 30)}</p></article><input value=go></form></body>") for i in range(6)]
    rows += [(10 + i, f"https://b.example/{i}", f"<body><form><div class=text><p>{words(f'b{i}', 30)}</p></div><button>Send</button></form></body>") for i in range(6)]
    rows += [(20 + i, f"https://c.example/{i}", f"<body><div class=text><p>{words(f'c{i}', 30)}</p><form class=f>Your name {i}<input></form></div></body>") for i in range(6)]
    got = texts(spark, rows)
    assert got == {at + i: words(f"{name}{i}", 30) for at, name in ((0, "a"), (10, "b"), (20, "c")) for i in range(6)}


def test_names_count_as_a_whole(spark):
    body = "<article><p>{0}</p><p class=related-work>{1}</p><p class=search-method>{2}</p><div class='ad-slot x'>buy {3}</div><p class=sponsored>deal {3}</p></article>"
    rows = [(i, f"https://a.example/{i}", body.format(*(words(f"{c}{i}", 12) for c in "abc"), i)) for i in range(7)]
    assert texts(spark, rows) == {i: " ".join(words(f"{c}{i}", 12) for c in "abc") for i in range(7)}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_constant_paragraphs_go_at_any_number_of_pages(spark, n):
    rows = [(i, f"https://a.example/{i}", f"<article><p>{words(f'own{i}', 40)}</p><p>{words('same', 20)}</p></article>") for i in range(n)]
    assert texts(spark, rows) == {i: words(f"own{i}", 40) for i in range(n)}


@pytest.mark.parametrize("n", [2, 5, 9])
def test_near_copies_keep_their_text(spark, n):
    rows = [(i, f"https://a.example/{i}", f"<article><p>{words('same', 40)}</p><p>edit {i}</p></article>") for i in range(n)]
    assert texts(spark, rows) == {i: f"{words('same', 40)} edit {i}" for i in range(n)}


def test_pages_without_article(spark):
    html = "<body><div class=logo>The Daily</div><ul id=main-nav><li>Home<li>World</ul><div id=wrap><h1>Head {0}</h1><div class=text><p>{1}</p><div class=ad>buy {0}</div><p>{2}</p></div></div><div class=legal>Printed in Bern</div><div class=comments><p>reader {0}</p></div></body>"
    rows = [(i, f"https://a.example/{i}", html.format(i, words(f"p{i}", 20), words(f"q{i}", 20))) for i in range(6)]
    assert texts(spark, rows) == {i: f"Head {i} {words(f'p{i}', 20)} {words(f'q{i}', 20)}" for i in range(6)}


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "deep text", "<b>" * 20_000 + "<li>" * 200 + "deep text", "<div><p>" * 10_000 + "deep text" + "</i></span>" * 10_000, "<table><tr><td>" * 7_000 + "deep text"])
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    assert wrapper_html.blocks(wrapper_html.parse(html)) == ["deep text"]
    assert time.process_time() - began < 1
    wrapper = wrapper_html.induce([html, html.replace("deep", "other")])
    page = wrapper_html.extract(html, wrapper | {"template": set(), "inside": True})
    assert page == "deep text" and time.process_time() - began < 5
