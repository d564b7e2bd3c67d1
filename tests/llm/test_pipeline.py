import hashlib
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import toxicity
from tessera.llm.lm_scoring import crc_remainder

from .test_decontamination import brute as leaks_of
from .test_line_dedup import brute as lines_of  # noqa: F401
from .test_ngram_jaccard import brute as components_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(40)) for i in range(4)]
    common, base = prose(12), prose(90)
    texts = [None, "", "  ", base, base]
    for i in range(4):
        w = base.split()
        w[20 * i] = "changed"
        texts.append(" ".join(w))
    texts += [prose(20) + "\n" + common + "\n" + prose(15) for _ in range(7)]
    texts += [prose(10) + " " + items[1][1].upper().replace(" ", "  ") + " " + prose(9), items[2][1][:100]]
    for i in range(300):
        t = prose(60).split()
        if i % 3 == 0:
            for _ in range(5):
                t.insert(rnd.randrange(len(t)), rnd.choice(("vile", "foul,", "nasty")))
        texts.append(" ".join(t))
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    first = len(texts) - 300
    labels = [(first + i, 1, int(i % 3 == 0)) for i in range(300)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(Path(folder) / f"{name}.parquet"))
    return items


def test_stages_against_brute_force(spark, tmpdir_path):
    items = tables(spark, tmpdir_path)
    docs = spark.read.parquet(f"{tmpdir_path}/documents.parquet")
    steps = [docs]
    for _, f in P.STAGES[:-1]:
        out = f(spark, steps[-1], tmpdir_path)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmpdir_path}/step{len(steps)}")
        steps.append(spark.read.parquet(f"{tmpdir_path}/step{len(steps)}"))
    at = [{r.doc_id: r.text for r in s.collect()} for s in steps]

    model = toxicity.fit(docs, spark.read.parquet(f"{tmpdir_path}/labels.parquet"), crc_remainder("doc_id", 5) == 0)
    assert at[1] == {d: t for d, t in at[0].items() if model.score((t or "").encode()) < 0.5}
    wrong = sum((d in at[1]) == (i % 3 == 0) for i, d in enumerate(range(len(at[0]) - 300, len(at[0]))))
    assert wrong <= 15 and set(range(18)) <= set(at[1])

    want = {d: (n, x, h) for d, n, x, h in lines_of([(d, t or "") for d, t in at[1].items()], 40, 5)}
    assert at[2].keys() == at[1].keys()
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == want[d][2] for d, t in at[2].items())
    assert at[2][0] is None and sum(x[1] for x in want.values()) == 6

    comps = components_of([(d, t or "") for d, t in at[2].items()], 5, 80)
    assert at[3] == {d: t for d, t in at[2].items() if comps[d][1] == d}
    assert len(at[3]) == len(at[2]) - 5
    assert at[4] == {d: t for d, t in at[3].items() if not leaks_of(items, t or "")}
    assert len(at[4]) == len(at[3]) - 2

    from tokenizers import Tokenizer

    from tessera.llm.bpe import default_path
    library = Tokenizer.from_file(default_path())
    got = {r.doc_id: r for r in P.run(spark, tmpdir_path).collect()}
    assert got.keys() == at[4].keys()
    for d, t in at[4].items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[d].ids), "<u4").tolist() == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_tables(spark, tmpdir_path):
    tables(spark, tmpdir_path)
    none = spark.read.parquet(f"{tmpdir_path}/documents.parquet").filter(F.lit(False))
    for _, f in P.STAGES:
        assert f(spark, none, tmpdir_path).count() == 0


def test_near_copies_of_repeated_ids(spark):
    """Rows of one id with different texts are judged each for itself; rows that repeat both stay once."""
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (3, b), (5, a), (None, a), (9, None), (9, "")]
    for order in (rows, rows[::-1]):
        out = P.without_near_copies(spark, spark.createDataFrame(order, "doc_id long, text string"), "")
        assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame(
            [(5, a), (3, b), (None, a), (9, None), (9, "")], "doc_id long, text string").collect()))
