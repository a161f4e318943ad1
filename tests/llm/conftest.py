import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words=None):
    words = words or [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "sta", "")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(11)
    long = sentence(rng, 30_000)
    base = sentence(rng, 120)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, "one", "en", None), (5, "One two", "en", "b"),
        (6, long, "en", "a"), (7, base, "en", "a"), (7, base, "en", "a"), (8, base, "de", "b"), (None, base, "en", "a"), (None, None, None, None),
        (9, base + "\n" + base, "en", "c"), (10, "x" * 5000, "en", "c"), (11, "é ñ 日本語 🙂 | # <b>", "fr", "c"), (12, base.replace(" ", "\n"), "en", "c"), (7, "another text with this id", "en", "b"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
