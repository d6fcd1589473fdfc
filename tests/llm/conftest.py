import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns that clash with internal names."""
    words = [f"w{i}" for i in range(4000)]
    texts = [
        (1, "the quick brown fox jumps over the lazy dog again and again while it rains outside today"),
        (2, "the quick brown fox jumps over the lazy dog again and again while it rains outside today"),
        (2, "the quick brown fox jumps over the lazy dog again and again while it rains outside today"),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (None, "the quick brown fox jumps over the lazy dog again and again while it rains outside today"),
        (None, None),
        (7, " ".join(words)),
        (8, "prefix " + " ".join(words[100:400]) + "\nsuffix"),
        (9, "é漢字 ß🙂 don't we'll <|endoftext|> 's  x  \n\n  y"),
        (10, "a a a a a a a a a a a a a a a a a a"),
        (11, "a a a a a a a a a a a a a a a a a a a a"),
        (12, "two words"),
        (13, "One line of five words\nsecond line with five words\nOne line of five words"),
    ]
    rows = [(i, t, "xx", k, len(t or "")) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string, h int, n_chars bigint").repartition(3)
