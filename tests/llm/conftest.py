from pathlib import Path

import pytest

from hedgewatch.llm.queries import tokenizer_file

SMALL = Path("/root/testdata/sf0.001")
ODD_TEXTS = ["", None, " ", "a", "a  b \n c\t", "Été à l'ombre, I'm we'll", "x" * 5000, "word " * 3000, "<|endoftext|> a<|startoftext|>b",
             "日本語 テキスト 😀", "\x00 \x01", "don't 12 345 ... !!! é́", "same text here twice", "same text here twice"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, missing ids, and columns named like those that operators make."""
    rows = [(i, t, 7, "s") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", 7, None), (None, None, 7, None), (3, "a", 7, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, shard string").selectExpr(
        "*", "1 AS size", "2 AS piece", "3 AS fingerprint", "4 AS ids", "5 AS key", "6 AS statistics", "7 AS position", "8 AS place")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def byte_file():
    return tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_file():
    return tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="session")
def sf_dir():
    if not SMALL.exists():
        pytest.skip("needs the test tables")
    return str(SMALL)
