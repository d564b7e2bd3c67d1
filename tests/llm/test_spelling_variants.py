import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling_variants as sv
from tessera.llm.queries import QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    """Exactly one code point inserted, deleted or replaced."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute(rows, every=199, min_chars=6, min_count=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    out = {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, n, len(others), words.get(form)]

    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


def got(df, **a):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.variant_groups(df, **a).collect()}


def make_rows(seed, docs=60):
    rnd = random.Random(seed)
    base = ["banana", "bananas", "ananab", "colour", "color", "côlour", "parallel", "paralel", "parallle", "aaaaaa", "aaaaaaa", "aaaaaab",
            "Éclairs", "éclairs", "eclairs", "straße", "strasse", "abcdef", "abcdeg", "abcdefg", "bcdefg", "x" * 300, "x" * 301]
    for w in base[:12]:
        for _ in range(4):
            k = rnd.randrange(len(w))
            base.append(w[:k] + rnd.choice(["", "q", "é"]) + w[k + rnd.randrange(2):])
    weights = [rnd.choice([1, 2, 6, 40, 300]) for _ in base]
    rows = [(rnd.randrange(docs), " ".join(rnd.choices(base, weights, k=rnd.randrange(200))) + rnd.choice(["", ".", "×÷", " BANANA-banana"]))
            for _ in range(docs)]
    rows += [(500 + i, "chained " * 3 + "chaimed " * 20 + "chalmed " * 110) for i in range(2)]
    return rows + [(None, "banana " * 30), (3, None), (4, ""), rows[0], rows[0]]


@pytest.mark.parametrize("seed,every", [(1, 199), (2, 7), (3, None)])
def test_against_brute_force(spark, seed, every):
    rows = make_rows(seed)
    want = brute(rows, every)
    assert any(x[0] for x in want.values()) and any(x[1] != x[0] for x in want.values() if x[0])
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), every=every) == want


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame(make_rows(4), "doc_id long, text string")
    extra = df.withColumns({"word": F.lit("w"), "n": F.lit(1), "letters": F.lit("abc"), "sig": F.lit(0)})
    assert got(extra) == got(df) == brute(make_rows(4))
    assert got(df.limit(0)) == {}


def test_signatures_meet_whenever_vectors_are_within_reach():
    rnd = random.Random(7)
    part = sv.deal_parts([(f"{c}1", rnd.randrange(90)) for c in "abcdefghijklmnopqrstuvwxyzé"])
    for _ in range(500):
        w = "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(6, 12)))
        k = rnd.randrange(len(w))
        v = w[:k] + rnd.choice(["", "z", "a", "é"]) + w[k + rnd.randrange(2):]
        a, b = sorted(w), sorted(v)
        assert set(sv.signatures("".join(a), part)) & set(sv.signatures("".join(b), part))
        assert bool(sv.differing("".join(a), "".join(b))) or a == b or not near(w, v)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op11_spelling_variants"](spark, sf)
    assert set(df.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()} == brute(rows)
