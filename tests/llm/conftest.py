import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, digest string, n long, prefix string, kept boolean"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None, 1, "k", "d", 2, "p", None)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank and very long texts, repeated rows, a null id, other scripts, columns with names used inside."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n\x0b "), row(4, "one"), row(5, base), row(5, base), row(6, base.upper()), row(7, base + " more"), row(8, None, None),
        row(None, base + " and a null id with words of its own kind here"), row(9, "The same five words again and again. " * 4000), row(10, "ünï 中文 🙂 <|endoftext|> \x1c\x85 x"), row(11, "a  b\n\n c "),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def few_labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, None), (9, 0, 1), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
