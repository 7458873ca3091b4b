import pytest

#: Null in every column, empty, white space, repeated rows and ids, ties, a very long text, special tokens, unusual characters.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. It's fine!", "en"),
    (1, "The quick brown fox jumps over the lazy dog. It's fine!", "en"),
    (2, "", None),
    (3, None, "en"),
    (None, "a b c d e f", None),
    (None, None, None),
    (4, "  \t\n  ", "de"),
    (5, "word " * 30_000, "en"),
    (6, "Ünïcödé ΣΑΣ 日本 🙂 <|endoftext|> x <|startoftext|>\x1c\x00 tail  two", "fr"),
    (7, "THE QUICK brown fox jumps over the lazy dog. It's fine!", "en"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Those rows, and extra columns whose names operators also use."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("score", "label", "rank", "size", "shard", "code_0", "key", "node", "part", "cell", "source")}).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
