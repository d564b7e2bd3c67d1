import re

from tessera.llm.license_scan import PHRASES, digest, edits, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    out = []
    for d, t in rows:
        w = WORD.findall(t.encode().lower().decode())
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        s = [i for i, _ in at]
        out.append((d, len(w), len(at), min(s, default=None), max(s, default=None), ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=str)


TEXTS = ["CC-BY 4.0", "cc  by cc by cc by", "CC BYE", "the General\nPublic, License all rights reserved. All Rights Reserved",
         "all rights", "general public general public license", "Released under the MIT License.",
         "Released under the famous MIT License.", "nothing here", "ünder cc by é", "by cc", "CC\x1fBY", "all_rights_reserved",
         "This work is licensed under the GNU General Public License, version 3.", "cc by " * 700,
         "Permission is hereby granted, free of charge, to any person getting a copy of this software and its documentation files"]


def test_base_against_brute_force(spark, docs, rows):
    more = [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1001, "all rights reserved"), (1001, "all rights reserved")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = digest(scan(df)).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == brute(rows + more)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1 or not r.n_base
    by = {r.doc_id: r for r in out if r.doc_id >= 1002}
    assert by[1006].labels == by[1007].labels == "mit" and by[1006].score == 1 > by[1007].score
    assert by[1013].labels == "gpl,gpl-3.0" and by[1015].labels == "mit" and by[1008].labels == ""


def test_edits():
    w = lambda s: s.encode().split()
    assert edits(w("a b c"), w("x a b c y"))[0] == 0
    assert edits(w("a b c"), w("a x b c")) == (1, 2, 4) or edits(w("a b c"), w("a x b c"))[0] == 1
    assert edits(w("a b c"), [])[0] == 3


def test_empty(no_docs):
    assert digest(scan(no_docs)).count() == 0
