from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

EXTRA = "text_key string, position int, kept string, component_id string, tokens string, rank int, found string, lang string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows with columns whose names the operators use inside."""
    lang = {0: "en", 1: "fr"}
    filled = [(d, t, "x", 7, None, "y", None, 3, "z", lang.get((d or 0) % 2), None if t is None else len(t)) for d, t in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, {EXTRA}")


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """Nulls, empty, blank and very long texts, repeated rows, one id with two texts, odd characters."""
    long = prose(1, 30_000)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b "),
        (4, "one"),
        (4, "one"),
        (5, prose(2, 80)),
        (5, prose(3, 80)),
        (6, prose(2, 80)),
        (7, long),
        (8, long + " tail"),
        (9, "x" * 200_000),
        (10, "été ▁ 😀   \x00 \x1c İ ſ K 日本語"),
        (11, "\n\n\n"),
        (12, "0" * 50_000),
        (None, "no id at all, but a text of its own"),
        (None, None),
        (13, "a line that three documents hold\nand " + prose(4, 10)),
        (14, "A LINE that three documents hold  \nor " + prose(5, 10)),
        (15, "  a line that three documents hold\nor " + prose(6, 10)),
    ]


@pytest.fixture(scope="session")
def edge(spark: SparkSession, edge_rows: list[tuple]) -> DataFrame:
    return documents(spark, edge_rows).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
