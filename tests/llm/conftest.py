import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, copies, near copies, a long text, and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, "Hello World"), (2, "hello world"), (3, None), (4, ""), (5, " \t\n "), (6, base), (7, base.replace("w30 ", "x ")), (8, base.upper()), (9, base.replace("w10 ", "").replace("w50 ", "")),
        (10, "É é ÀB"), (11, "é é Àb"), (12, " ".join(f"long{i % 997}" for i in range(20000))), (13, "one"), (14, "one two"), (15, "One  two"),
    ]
    return spark.createDataFrame([(i, t, "n", "k", i % 3) for i, t in rows], "doc_id long, text string, norm string, id string, size long")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")
