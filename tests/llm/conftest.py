import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, c double, node string, part int, n int, digit string, rest string, epoch string, host int, path int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, with nulls elsewhere and extra columns whose names clash with internal ones."""

    def f(rows, lang="en", source="src1"):
        return spark.createDataFrame([(d, t, lang, source, None, "x", 1, 0.5, None, 3, None, "d", None, "e", 1, None) for d, t in rows], SCHEMA).repartition(3)

    return f


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of the small documents table."""
    return duckdb.connect().sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()


ODD = [
    (1, None),
    (2, ""),
    (3, "one"),
    (4, "one"),
    (5, " \t\n "),
    (6, "Ünï wörds and 日本語 text, again and again"),
    (7, "Ünï wörds and 日本語 text, again and again"),
    (8, " ".join(f"w{i % 7}" for i in range(400))),
    (9, " ".join(f"long{i}" for i in range(60000))),
    (10, "x" * 300000),
    (11, "a\x0bb\x0cc\x1cd\x85e\xa0f  g\r\nh"),
    (None, "one"),
    (None, None),
    (-5, "one"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
