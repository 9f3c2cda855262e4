import pytest

#: Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those the operators use.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 5),
    (2, "the QUICK brown fox jumps over the lazy dog again and again", "en", "a", 5),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "x " * 3000, "en", "b", 1),
    (5, "x " * 3000, "en", "b", 1),
    (None, "no key here <|endoftext|> at all", "de", "b", 2),
    (7, "Ünïcode — ñandú   日本語\n\n\t tabs  and   spaces ", "es", "c", 2),
    (8, "it's we'll 'd \x1c \x85 1234½", "es", "c", 2),
    (9, "word", "en", None, 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "part", "row", "fp", "n", "size", "words"):
        docs = docs.withColumn(name, docs.lang)
    return docs.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
