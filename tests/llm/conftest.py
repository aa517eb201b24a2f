import pytest
from pyspark.sql import functions as F

from stopflow.llm.shipping import ship

LICENSED = "Some code.\nReleased under the MIT License. CC BY-NC 4.0 and Apache License, Version 2.0"
LONG = " ".join(f"wort{i % 997} und{i % 31}" for i in range(20_000))


def texts():
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    near = base.replace("alpha30 ", "changed ")
    rows = [
        (1, base),
        (2, base),
        (3, near),
        (4, None),
        (5, ""),
        (6, "  \n\t "),
        (7, LICENSED),
        (7, LICENSED),
        (8, "One"),
        (9, "one"),
        (10, "a b c"),
        (11, LONG),
        (12, LONG + " tail of it"),
        (None, base),
        (None, None),
        (13, "Ça va bien  là　oui \u0085 x y  <|endoftext|> don't 12345 naïve"),
        (14, "under the mit license under the MIT license UNDER the mit-license"),
    ]
    return rows


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with missing, empty, long and repeated values and extra columns."""
    ship(spark)
    rows = [(i, t, ["en", None, "fr"][k % 3], [None, "a", "b"][k % 3]) for k, (i, t) in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns(
        {c: F.lit("clash") for c in ("size", "key", "score", "node", "ids", "word", "n_chars")}
    )


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)
