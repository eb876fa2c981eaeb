import pytest

#: Texts that operators must survive: nulls, empties, blanks, ties, repeats, odd characters, one long word, one long text.
ODD = [None, "", " ", "\n\n", "one", "a b", "a b c d", "a b c d", "é ü ñ x \U0001f600 z", "x" * 5000, "w " * 9000, "\u0000 \t\x0b\x0c\r\n q", "Same line\nSame line\nother\n Same line", "<|endoftext|> tail <|endoftext|>", "1 2-3 4 5-6 7 8 9 0 1 2 3 4 5 6"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """The small documents followed by the odd ones, as {doc_id: text}."""
    found = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = max(found) + 1
    return found | {base + i: t for i, t in enumerate(ODD)}


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with clashing extra columns, over several partitions."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int").repartition(4)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
