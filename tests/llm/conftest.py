import pytest


@pytest.fixture(scope="session")
def documents():
    """Texts with what real ones have: copies, ties, nulls, nothing, very long ones."""
    base = " ".join(f"word{i} thing{i * 7 % 13}" for i in range(120))
    near = base.replace("word50 ", "changed ").replace("word90 ", "other ")
    rows = [
        (0, base),
        (1, near),
        (2, base.upper()),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, "one two"),
        (7, "one two"),
        (8, "one two three four five six seven eight nine ten"),
        (9, "ten nine eight seven six five four three two one"),
        (10, " ".join(f"long{i % 5000}" for i in range(60_000))),
        (11, "é ñ ß 日本語 😀 Élan über naïve " * 3),
        (8, "one two three four five six seven eight nine ten"),
    ]
    return [(i, t, "en", "src", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
