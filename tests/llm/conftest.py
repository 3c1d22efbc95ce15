import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, block int, h long, key string, owner long, rep long, n long, training boolean,"
    " __block int, __score double, __spans string, __id long, __items string, __n_words long, __positive string, digest long, node long, kept string"
)


@pytest.fixture(scope="session")
def frame():
    def made(spark, rows):
        """documents with extra columns whose names clash with those that operators use inside."""
        clash = (777, 2, "k", 3, 4, 5, True, 777, 0.5, "x", 6, "y", 7, "z", 8, 9, "w")
        full = [(i, t, lang, "s", len(t or ""), *clash) for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA)

    return made


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(["alpha", "beta", "gamma", "delta", "été", "ñandú", "omega", "sigma"]) + str(r.randint(0, 400)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and blank texts, very long texts, exact and near copies, repeated rows, a null id."""
    base = words(120, 1)
    near = [w if i % 40 else w + "x" for i, w in enumerate(base)]
    far = [w if i % 6 else w + "y" for i, w in enumerate(base)]
    line = "This very common line stands in many documents."
    out = [
        (1, None, "en"), (2, "", "en"), (3, "   \n\t", "en"), (4, "One two", "en"), (5, "ONE  two", "fr"), (6, "!!! 123", None),
        (10, " ".join(base), "en"), (11, " ".join(base).upper(), "en"), (12, " ".join(near), "en"), (13, " ".join(far), "en"), (13, " ".join(far), "en"),
        (20, f"{line}\nown line of twenty\n{line.upper()} ", "en"), (21, f"own other line\n {line}\nshort", "en"), (22, line, "en"),
        (30, " ".join(words(30_000, 5)), "es"), (None, "no id here, but words that count", "en"), (31, "mail a.b@c.example.com now +1 (555) 010-9999 or 10.0.0.7", "en"),
    ]
    return out + [(100 + i, " ".join(words(40 + i, 100 + i)), "en") for i in range(30)]


@pytest.fixture()
def docs(spark, rows, frame):
    return frame(spark, rows)


@pytest.fixture()
def empty(spark, frame):
    return frame(spark, [])
