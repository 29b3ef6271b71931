import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def make_rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, odd white space, repeated rows and ids."""
    rng = random.Random(3)
    base, passage = words(rng, 300), words(rng, 70)
    rows = [
        (0, base), (1, base), (2, base.replace(base[40:46], "zzz", 1)), (3, words(rng, 60) + "\n" + passage + "\t" + words(rng, 30)),
        (4, words(rng, 10) + " " + passage.replace(" ", "  ") + " " + words(rng, 5)), (5, " ".join(passage.split()[:52])), (6, " ".join(passage.split()[:49])),
        (7, None), (8, ""), (9, " \n\t"), (10, "Ünï cödé 日本語 \U0001f600 x²"), (10, "Ünï cödé 日本語 \U0001f600 x²"), (11, words(rng, 4000)), (12, base + " " + base),
        (13, "Released under the MIT License."), (None, base), (None, "orphan text here"), (15, passage + " " + passage), (15, words(rng, 55)), (16, "a b c d"), (17, "A  b\vc D"),
    ]
    rows += [(20 + k, words(rng, rng.randint(1, 120))) for k in range(30)]
    return [(i, t, "en", [None, "s1", "s2", "s0"][k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with other columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("key", "line", "shared", "group", "fp", "score", "size", "target", "taken", "quota", "first", "_words", "__key", "__line", "__sha", "__k", "__id", "__first", "__kept", "k", "sha", "kept", "id", "n", "h")
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(clash))).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
