"""Template is counted over all distinct pages of a host."""

from stripweave.llm import wrapper_html

NOTICE = " ".join(f"notice{k}" for k in range(45))


def page(host, i):
    own = " ".join(f"{host}{i}x{k}" for k in range(60))
    return f"<html><body><article><p>{own}</p><p>{NOTICE}</p></article></body></html>", own


def test_template_over_all_pages(spark):
    rows, want = [], {}

    def add(host, html, text):
        rows.append((len(rows), f"https://{host}.example/{len(rows)}", html))
        want[len(rows) - 1] = text

    for host, pages in (("two", 2), ("odd", 7), ("copies", 5), ("one", 1)):
        for i in range(pages):
            html, own = page(host, i)
            for _ in range(40 if host == "copies" else 1):  # many copies of every page
                add(host, html, f"{own} {NOTICE}" if host == "one" else own)
    add("odd", "<table><tr><td>other layout</table>", "other layout")
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in wrapper_html.main_text(frame).collect()} == want
