"""Small tables with the awkward cases: null ids and texts, empty and long texts, ties,
repeated rows, and columns named like the operators' own."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, slot string, score double, row string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def messy_rows():
    same, passage = prose(1, 80), prose(2, 70)
    texts = [same, same, same + " tail", "", None, " \n\t ", "one", "one two", "é ü ▁ 中文  x", prose(3, 4000),
             prose(4, 40) + " " + passage + " " + prose(5, 30), prose(6, 25) + "\n" + passage + " " + prose(7, 50),
             "A B C d e f g h i j k", "w " * 60, "x" * 20000, prose(8, 90)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", len(t or ""), 7, "s", 0.5, "r") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[9], (None, prose(8, 90), None, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None), (8, "another text under the same id", "de", "src0", 1, 1, "", 0.0, "")]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(16)] + [(None, 1, 0), (3, None, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
