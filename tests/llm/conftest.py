import zlib
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.01"

# One text of each awkward kind, under ids that are checked against the tests' own brute force.
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "word"),
    (5, "two words"),
    (6, "Ünïcode 你好 \x1c odd spaces é ﬁ"),
    (7, LONG),
    (8, PASSAGE + " and more of it in this one"),
    (9, "before it came " + PASSAGE),
    (10, "same text in two rows " * 30),
    (11, "same text in two rows " * 30),
    (12, "Same TEXT in two rows " * 30),
    (12, "Same TEXT in two rows " * 30),
    (None, "a row without an id " * 30),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The awkward texts, with extra columns whose names clash with those of operators."""
    rows = [(i, t, "en" if i and i % 2 else None, "src", 0, "x", 1.5) for i, t in AWKWARD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `hash` string, statistics double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(str(Path(SF) / f"{name}.parquet"))


@pytest.fixture(scope="session")
def remainder():
    return lambda doc_id: zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5
