from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Ids and texts that every operator has to bear: nulls, empty texts, repeated rows, ties, one very long text.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "The  quick brown fox\tjumps over the lazy dog"),
    (2, "The  quick brown fox\tjumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "The quick brown fox jumps over the lazy dog"),
    (None, None),
    (6, "één twee drie vier vijf zes zeven 你好 😀 mail a@b.example.com"),
    (7, "w" + " lorem ipsum dolor sit amet" * 40_000),
    (8, "x" * 200_000),
    (9, "one"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with other columns whose names clash with those that operators make."""
    rows = [(i, t, 1, "x", None, 0.5, "y") for i, t in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, key int, slot string, kept string, score double, node string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    def read(name: str, sf: str = SF_DIR):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    return read
