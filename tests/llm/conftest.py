"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "the", "of", "delta,", "épsilon", "zeta.", "eta", "Theta", "iota", "kappa", "λάμδα", "mu"]


def make_docs():
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    passage, other = text(50), text(36)
    base = text(120)
    near = base.split()
    rows = [None, "", "   \n\t ", "one", "one", base, base, base.upper(), text(20) + " " + passage + " " + text(30),
            text(10) + "\n" + passage, passage + " " + passage, "x " + other, other + " y", other[:-1],
            text(3000), "a" * 20000, "word " * 500, "\n\n", "same line of at least forty characters, repeated here\nb",
            "\x0b\x1f mixed blank  wide", "don't  stop   \n  <|endoftext|> 12 345 x"]
    for i in range(6):
        w = list(near)
        w[i * 15] = f"edit{i}"
        rows.append(" ".join(w))
    for i in range(7):
        rows.append(f"head {i}\n Same Line of at least forty characters, repeated here \t\n{text(4)}\n{text(12)}")
    return [(i * 3 + 1, t, "en", f"src{i % 2}", len(t or ""), i, "clash") for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, h string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1] or "") for r in make_docs()]
