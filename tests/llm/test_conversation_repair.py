import functools
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as cr
from tessera.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(symbols):
    """Least (cost, edits) of a symbol string, row by row and without any table: edits as one entry a row and a tail."""
    n = len(symbols)

    @functools.cache
    def best(i, q, inserted):
        ways = []
        if i == n and q in (cr.START, cr.ASSISTANT):
            ways.append((0, ""))
        if inserted < 3:
            c, e = best(i, cr.NEXT[q], inserted + 1)
            ways.append((c + 3, "I" + e))
        if i < n:
            s = symbols[i]
            c, e = best(i + 1, q, 0)
            ways.append((c + 4, "D" + e))
            if s != cr.GONE:
                extra = 3 if s % 2 else 0
                c, e = best(i + 1, cr.NEXT[q], 0)
                ways.append((c + 3 + extra, "R" + e))
                role = "sua?"[s // 2]
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, q))
                if to is not None:
                    c, e = best(i + 1, to, 0)
                    ways.append((c + extra, "K" + e))
        return min(ways, default=(10**9, ""))
    for i in range(n, 0, -1):                             # from the end, so that the recursion stays flat
        for q in range(4):
            best(i, q, 0)
    return best(0, 0, 0)


def expected(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c]
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(x for x in text if x not in ".!?") if draw == 2 else text
        row = (t, "user" if draw == 4 else role, text)
        convs[c] += [row, row] if draw == 3 else [row]
    out = {}
    for c, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), [], defaultdict(int)
        for _, role, text in got:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            kind = "sua".find(role[:1]) if role else -1
            symbols.append(cr.GONE if fault in ("blank", "duplicate") else 2 * (kind if kind >= 0 else 3) + (fault == "truncated"))
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(got, got[1:]))
        turns = [t for t, _, _ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = plain(tuple(symbols)) if got else (0, "")
        fixed, at, last = [], iter(got), ""
        for x in audit:
            row = next(at) if x != "I" else None
            if x == "D":
                continue
            role = row[1] if x == "K" else "assistant" if last == "u" else "user"
            fixed.append(f"{role}:{'' if x == 'I' else row[2]}")
            last = role[0]
        sha = hashlib.sha256("\n".join(fixed).encode()).hexdigest()
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def got(spark, rows):
    df = cr.repair_report(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_block_tables_against_plain_search(seed):
    rnd = random.Random(seed)
    t = cr.Tables()
    assert len(t.vectors) < 100
    for n in [*range(1, 14)] * 12:
        symbols = tuple(rnd.randrange(cr.SYMBOLS) for _ in range(n))
        cost, edits, tail = t.repair(bytes(symbols))
        assert len(edits) == n and (cost, "".join(edits) + tail) == plain(symbols)


def make_rows(seed, convs=60):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", "  \n", None, "Done. \t", "é ", "…"]
    rows = []
    for c in range(convs):
        for t in range(rnd.randrange(9)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            rows.append((c, rnd.choice([t, t, t, t + 1, None]), role, rnd.choice(texts) if rnd.random() < 0.4 else f"text {rnd.random()}."))
        if rnd.random() < 0.2 and rows:
            rows.append(rows[-1])
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Hello."), (None, None, None, None)]
    return rows


def test_against_plain_search(spark):
    rows = make_rows(1)
    assert got(spark, rows) == expected(rows)


def test_long_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK_ROWS", 7)
    rnd = random.Random(3)
    rows = [(5, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", f"{t}?", ""])) for t in range(400)] + make_rows(2, 5)
    rows += [(77, 3, "user", "same row.")] * 50
    assert got(spark, rows) == expected(rows)


def test_whole_table_and_extra_columns(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op13_conversation_repair"](spark, sf)
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == expected(rows)
    clash = spark.createDataFrame(rows[:40], SCHEMA).withColumns({"conv": F.lit("x"), "no": F.lit(1), "symbols": F.lit(2)})
    assert {r[0]: tuple(r)[1:] for r in cr.repair_report(clash).collect()} == expected(rows[:40])


def test_empty(spark):
    assert got(spark, []) == {}
