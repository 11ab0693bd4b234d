"""Small tables with the awkward cases, and brute-force counterparts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "iota", "zeta", "é", "ß"]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) + draw.choice("abcdefgh") for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids and texts."""
    shared = prose(1, 60)
    rows = [
        (1, shared, "en", "b", 5), (2, shared, "en", "b", 5), (2, shared, "en", "b", 5),
        (3, prose(2, 30) + " " + shared + "\n" + prose(3, 30), "de", None, None),
        (4, None, None, "a", None), (5, "", "en", "a", 0), (6, " \t\n", None, None, 3),
        (None, prose(4, 50), "de", "a", 1), (None, None, None, None, None),
        (7, prose(5, 20_000), "de", "c", 9), (8, "é" * 130 + shared, None, "b", 2),
        (9, "one two", "en", "c", 7), (10, "one  two", "en", "c", 7),
        (11, " ".join(["again"] * 120), "en", "b", 1), (12, "a" * 400, "de", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text) -> list[bytes]:
    return (text or "").encode().split()
