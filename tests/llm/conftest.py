import pytest

LONG = "\n".join(f"line {i} of a very long text, with word{i} and number {i * 7}." for i in range(4000))
TEXTS = [None, "", " \n\t ", "one", "two words", LONG, "the same text in two rows, word for word here", "the same text in two rows, word for word here", "ünï cödé – テキスト 漢字 🙂 <|endoftext|> \0 end", "a  b\n\n c \r\n d "]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a repeated and a null id, and columns whose names operators use."""
    rows = [(i if i != 9 else None, t, "x", i, 0.5, "y", "z") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "x", 6, 0.5, "y", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, key long, score double, removed string, private string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
