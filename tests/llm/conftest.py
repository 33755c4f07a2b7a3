import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, slot string, kept int"


def long_text(n=60_000):
    return " ".join(f"word{i * 7919 % 9973} and{i % 13}." for i in range(n // 12))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    tail = ("s", 1, "x", "y", "z", 1)
    texts = [
        None, "", " \n\t ", "One short line.", "123 456 | 7 -- 8", "á\u00a0ß 漢字 \u2028 end.",
        long_text(), "x" * 5000, "|" * 300, "a b c d e f g h.\n" * 40,
    ]
    rows = [(i, t, None if i % 3 == 0 else "en", *tail) for i, t in enumerate(texts)]
    rows += [rows[6], rows[1], (None, None, None, None, None, None, None, None, None)]
    rows += [(None, "One short line.", "de", *tail), (3, "another text under one id.", "", *tail)]
    return spark.createDataFrame([r[:9] for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
