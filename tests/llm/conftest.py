import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
DATA = "/root/testdata/sf0.001"

EXTRA = ("cls", "hash", "e", "comp", "rid", "digest", "size", "place", "shard", "slot", "t", "w", "x", "fold", "block", "sidx", "period", "nth", "key", "n", "v", "cands", "base", "score")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, clashing column names."""
    text = "One two three four five six seven eight nine ten eleven twelve."
    rows = [
        (1, text, "en", "a", 5),
        (2, text, "en", "a", 5),
        (2, text, "en", "a", 5),
        (3, text.upper(), None, None, None),
        (4, None, "en", "a", 0),
        (5, "", "", "", 0),
        (6, " \t\n\x0b\x0c\r ", "de", "null", 7),
        (7, "a b", "de", "b", 3),
        (8, "a  b", None, "b", 3),
        (None, text, "en", None, 5),
        (None, None, None, None, None),
        (9, "x" * 60_000, "en", "b", 60_000),
        (10, "1 " * 4000 + "+1" + "2 " * 900 + "3", "en", "b", 1),
        (11, "\n".join(["line of words é 日本語 🎉"] * 3000), "en", "c", 2),
        (12, "<|endoftext|> \x00 token = abcdef0123456789abcdef0123 a@b.co <|", "en", "c", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'z' AS {c}" for c in EXTRA])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]
