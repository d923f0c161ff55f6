import pytest

#: Edge cases that every operator on documents meets: nulls, empty and long texts, ties, repeated rows, odd white space.
TEXTS = [
    (1, "The quick brown fox, it's 42 times over.\nA new line"),
    (2, None),
    (3, ""),
    (4, "  two  spaces\t\ttabs \n\n lines   nbsp em x\x1cy 　"),
    (5, "word " * 9000),
    (6, "日本語 текст naïve é é ﬁ İstanbul <|endoftext|> $$$ 123456"),
    (6, "a second row with the same id"),
    (6, "a second row with the same id"),
    (None, "a row without id"),
    (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20),
    (8, "\n\nleading and trailing \n"),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", 0, 0.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, start int, ids double").repartition(3)
