"""Headings and labels that articles of a host share stay; constant notices among them go."""

import pytest

from stripweave.llm import wrapper_html

NOTICE = " ".join(f"notice{k}" for k in range(30))


def words(name, i, n):
    return " ".join(f"{name}{i}x{k}" for k in range(n))


def page(i):
    html = (
        f"<html><body><div class=top>Our site of the day</div><article><h1>Title {i}</h1><h2>Summary</h2><p>{words('s', i, 30)}</p><p>Author:</p><p>{words('a', i, 3)}</p>"
        f"<div class=part><h2>Method</h2><p>{words('m', i, 40)} <math><mi>x</mi></math> end.</p></div><div class=x1><h3>Join us</h3><p>Read all news every day.</p></div>"
        f"<p>{NOTICE}</p><div class=label>Result</div><p>{words('r', i, 20)}</p><p>With kind regards</p></article></body></html>"
    )
    text = f"Title {i} Summary {words('s', i, 30)} Author: {words('a', i, 3)} Method {words('m', i, 40)} x end. Result {words('r', i, 20)} With kind regards"
    return html, text


@pytest.mark.parametrize("n", [2, 4, 20])
def test_shared_headings_stay(spark, n):
    made = [page(i) for i in range(n)]
    rows = [(i, f"https://one.example/{i}", html) for i, (html, _) in enumerate(made)]
    got = {r.page_id: r.text for r in wrapper_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text for i, (_, text) in enumerate(made)}
