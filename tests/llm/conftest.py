import pytest
from llm_texts import ODD_COLUMNS, prose


@pytest.fixture(scope="session", autouse=True)
def work_folder(spark, tmp_path_factory):
    """The shared work folder of these tests."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a very long one, ties, repeated rows, null ids, nulls in every column, clashing columns."""
    long = prose(5, 30_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, long, "b"), (5, prose(1, 60), "a"), (5, prose(1, 60), "a"),
            (6, prose(1, 60), "b"), (7, prose(2, 60), "b"), (None, prose(2, 60), "b"), (None, None, None), (8, "x" * 5000, "c"),
            (9, "Größe λόγος 😀 " * 30, "c"), (10, prose(9, 200) + " mail me: a.b@example.org or +1 (555) 010-9999", "c")]
    extra = [None, 1, "x", "y", "z", "0", "m", "s", "o", "i", "k", "n", "r", "t"]
    data = [(i, t, "en", s, None if t is None else len(t), *[None if e is None or i == 6 else e for e in extra]) for i, t, s in rows]
    return spark.createDataFrame(data, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {ODD_COLUMNS}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
