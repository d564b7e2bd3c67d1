import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.line_dedup import LineRuns, dedup_lines, line_hashes


def brute(rows, min_chars, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    held = defaultdict(set)
    for d, t in rows:
        for line in t.split("\n"):
            held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = t.split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect())


def test_against_brute_force(docs, rows):
    for min_chars, min_docs, batches, fanout in ((40, 5, 3, 2), (1, 2, 5, 2), (3, 2, 4, 3)):
        got = dedup_lines(docs, min_chars, min_docs, batches, fanout)
        assert got.columns[:len(docs.columns)] == docs.columns
        assert digest(got) == brute(rows, min_chars, min_docs)


def test_repeated_ids_are_one_document(spark):
    line = "x" * 50
    df = spark.createDataFrame([(1, line), (1, line), (1, line), (2, line), (3, "y")], "doc_id long, text string")
    assert {r.n_dropped for r in dedup_lines(df, 40, 3).collect()} == {0}
    assert [r.n_dropped for r in dedup_lines(df, 40, 2).orderBy("doc_id").collect()] == [1, 1, 1, 0, 0]


def test_empty(no_docs):
    assert dedup_lines(no_docs).count() == 0


def test_levels_and_anti_join(spark, docs):
    runs = LineRuns(spark, 2)
    first = line_hashes(docs, 1).filter("doc < 30")
    runs.add(first)
    assert runs.new_lines(first).count() == 0
    rest = line_hashes(docs, 1).filter("doc >= 30")
    seen = {(r.h1, r.h2) for r in first.collect()}
    assert {(r.h1, r.h2) for r in runs.new_lines(rest).collect()} == {(r.h1, r.h2) for r in rest.collect()} - seen
    runs.add(rest)
    assert [len(x) for x in runs.levels] == [0, 1]
