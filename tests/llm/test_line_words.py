"""Line rules on words at line ends, and the verdict against plain Python."""

import re

import duckdb
import pytest

from stripweave.llm import line_rules, oracles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def fails(line, phrases):
    words = WORD.findall(line)
    dense, n = "".join(words), len(words)
    bars = sum(1 for w in words if w in "|»>•·")
    return (
        (n < 4 and not re.search(r"[.!?…。！？:;][\"'”’»)\]]*$", line.rstrip(SPACE)))
        or sum(dense.count(c) for c in "#*$%&|<>") > 0.1 * len(dense)
        or (len(dense) >= 20 and sum(c.isupper() for c in dense) > 0.6 * len(dense))
        or len(re.findall("!!+", dense)) * 3 > n
        or bars * 4 > n
        or (n <= 12 and re.search(phrases, line) is not None)
    )


def verdict(text):
    phrases = line_rules.boilerplate_pattern(line_rules.BOILERPLATE)
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    twice = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(3)}
    failed = len(words) < 50 or 100 * len(twice) > 50 * len(words)
    kept = [WORD.findall(x) for x in text.split("\n") if not fails(x, phrases)]
    chars, n = sum(len(w) for x in kept for w in x), sum(map(len, kept))
    return not failed and 100 * chars >= 70 * sum(map(len, words)) and 2 * n >= 50


LINES = ["alpha beta gamma"] * 5
BODY = [" ".join(f"word{i}x{k}" for i in range(9)) + "." for k in range(8)]
TEXTS = ["\n".join(LINES), "\n".join(f"   {x}  " for x in LINES), "\r\n".join(LINES), "\n".join(f"{x}. \r" for x in LINES), "\n".join(BODY), "\r\n".join(BODY), "  \n\t\n" + "\n".join(f" {x}" for x in BODY), "\n".join([*BODY, *["HOME | NEWS | ABOUT"] * 20]), "\n".join(BODY + ["Alle Rechte vorbehalten hier und dort"] * 9), None, "", " \n "]


@pytest.fixture(scope="module")
def judged(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r.doc_id: r for r in line_rules.line_quality(frame).collect()}


def test_white_space_at_line_ends_is_no_word(judged):
    assert [judged[i].cleaned for i in range(3)] == ["", "", ""]
    assert judged[3].cleaned == TEXTS[3]


def test_verdict_against_python(judged):
    assert [judged[i].kept for i in range(len(TEXTS))] == [verdict(t) for t in TEXTS]
    assert [judged[i].kept for i in (4, 5, 6, 7)] == [True, True, True, False]


def test_verdict_on_given_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.kept for r in line_rules.op4_line_rules(spark, sf).collect()}
    assert got == {r.doc_id: verdict(r.text) for r in rows.collect()} and len(set(got.values())) == 2


def test_sql_on_odd_lines(judged):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    names = [c[0] for c in con.execute(oracles.SQL["op4_line_rules"]).description]
    for row in con.fetchall():
        r = dict(zip(names, row))
        assert all(judged[r["doc_id"]][c] == r[c] for c in line_rules.COLUMNS)


def test_phrases_are_a_parameter(spark):
    frame = spark.createDataFrame([(1, "\n".join([*BODY, "click here for all the rest of this text"]))], "doc_id long, text string")
    assert "click here" not in line_rules.line_quality(frame).first().cleaned
    assert "click here" in line_rules.line_quality(frame, boilerplate={}).first().cleaned
