"""The wrapper keeps all text that is neither template nor furniture."""

from stripweave.llm import wrapper_html


def page(i, extra=""):
    intro = " ".join(f"intro{i}x{k}" for k in range(20))
    body = " ".join(f"body{i}x{k}" for k in range(40))
    html = (
        f"<html><body><div class=top>Our Site</div><nav>Home</nav><div class=wrap><h1>Head {i}</h1><div class=intro>{intro}</div>"
        f"<div class=text><p>{body}</p></div>{extra}</div><div class=line>Printed in Bern</div></body></html>"
    )
    return html, f"Head {i} {intro} {body}"


def test_text_beside_the_body_stays(spark):
    rows, want = [], {}
    for i in range(12):
        html, text = page(i)
        rows.append((i, f"https://many.example/{i}", html))
        want[i] = text
    # a block that the sampled pages need not have, and a page that the path does not fit
    html, text = page(50, "<div class=late>late words</div>")
    rows.append((50, "https://many.example/50", html))
    want[50] = f"{text} late words"
    rows.append((51, "https://many.example/51", "<table><tr><td>other layout</table>"))
    want[51] = "other layout"
    # a host with one page: nothing is known to be template
    html, text = page(60)
    rows.append((60, "https://one.example/60", html))
    want[60] = f"Our Site {text} Printed in Bern"
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper_html.main_text(frame).collect()} == want
