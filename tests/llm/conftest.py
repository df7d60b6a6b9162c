import pytest

LONG = " ".join(f"word{i % 977} and more" for i in range(30_000)) + "."
PASSAGE = "This very passage stands in many documents and is long enough to count."


def document_rows():
    """Odd documents: nulls in every column, empty and long texts, copies, repeated rows."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "b"), (3, "   \n\t", None, None), (4, "word", "de", "a"), (None, "text without an id " * 20, "en", "a"),
        (None, None, None, None), (5, LONG, "en", "c"), (6, "a b", "fr", None), (7, "1234 5678", "en", "b"), (8, "Ünï çödé \x00 text here", "de", "b"),
    ]
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix strange brews in quiet towers near the river bank at night. "
    rows += [(20 + i, base * 4 + f"tail {i}\n{PASSAGE}\nline number {i} of its own kind here.", "en", "hot") for i in range(12)]
    rows += [(40 + i, base * 5, "en", "hot") for i in range(8)]
    rows += [(60 + i, f"der hund und die katze laufen durch den wald {i} und über die wiese zum haus.\n  THIS very passage stands in many documents and is long enough to count.  ", "de", "a") for i in range(6)]
    rows += [(20, base * 4 + f"tail 0\n{PASSAGE}\nline number 0 of its own kind here.", "en", "hot")] * 2
    return rows


#: Columns that documents may carry besides their own, with names that operators use inside.
EXTRA = ["size", "score", "kept", "n_lines", "fp", "batch", "component_id", "target", "units", "digest"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in document_rows()], schema).repartition(5).cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, 1 if i < 40 else 0, 0) for i in range(1, 70)] + [(None, 1, 0), (3, None, 0), (5, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
