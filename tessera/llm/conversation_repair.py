"""Conversation structure repair with Four-Russians block tables.

A conversation should read ``(s?(ua)+)?`` in role initials: an optional system row, then user and assistant in turn. Edits: Keep (0),
Rerole to user or assistant (3), Delete (4, required for blank and duplicate rows), Insert an empty user or assistant row
anywhere (3); a truncated row that is not deleted adds 3. The cheapest edits are wanted, of several the ASCII-least sequence of initials.

1. *Faults.* Rows are put in order (turn, nulls first, then role and text) and each has its first fault: blank, duplicate (role and
   text seen earlier), truncated. Identical rows are counted before they are shuffled; whether a role and text came earlier is an
   aggregate over its least turn, joined back only where it occurs again.
2. *Chunks.* One range sort over all conversations; each task cuts its sorted rows into chunks of at most ``CHUNK_ROWS`` rows of one
   conversation, with one symbol a row (role class and fault). A conversation of any length is spread over tasks.
3. *Block tables.* The cost of what follows, by state of the pattern, is a vector; less its least entry only a few dozen vectors occur. For
   each of them and each block of ``BLOCK`` symbols a table holds the vector before the block and the cost to add. The
   tables are computed once a process; symbols are then taken a block at a time, from the last to the first.
4. *Tie-safe tracing.* The vectors between blocks are kept. From the first block on, each is expanded backward from the vector after
   it, and at each place the ASCII-least edit that still leads to the least cost is taken. How a block is traced
   from a state and a vector is remembered, so that it is mostly another lookup.

Only symbols (one byte a row, as long as the audit text itself) of a conversation come together in one task, never its texts; ``repaired``
gives the repaired rows chunk by chunk.

Edge cases: null roles and texts are read as one space, a null id or turn as one space where the damage is drawn; rows with a null id are one conversation;
turns that repeat are ordered by role and text; repeated rows are duplicates; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4
CHUNK_ROWS = 4096
#: Symbols: role class s, u, a, other, each whole or truncated; the last one is a row that must go.
CLASSES = "sua"
GONE = 8
SYMBOLS = 9
#: States of the pattern: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)                # where an inserted or reroled row leads; it is u unless the state is after u
ROLES = ("user", "user", "assistant", "user")
ENDS = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\x0c\r"


def symbol(initial: str, truncated: bool) -> int:
    kind = CLASSES.find(initial) if initial else -1
    return 2 * (kind if kind >= 0 else 3) + truncated


def kept_state(sym: int, state: int) -> int | None:
    """The state after keeping the row, None where the pattern does not allow it."""
    kind = sym // 2
    if sym == GONE or kind == 3:
        return None
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if state == USER else None


def before(sym: int, after: tuple) -> tuple:
    """Costs by state before a row, from those after it."""
    costs = []
    for q in range(4):
        ways = [DELETE + after[q]]
        if sym != GONE:
            ways.append(REROLE + TRUNCATED * (sym & 1) + after[NEXT[q]])
            kept = kept_state(sym, q)
            if kept is not None:
                ways.append(TRUNCATED * (sym & 1) + after[kept])
        costs.append(min(ways))
    for _ in range(3):                               # rows inserted before it: three lead round every state
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
    return tuple(costs)


class Tables:
    """Normalised cost vectors, numbered, and what every symbol and every block of symbols makes of each."""

    def __init__(self):
        self.vectors, self.number = [ENDS], {ENDS: 0}
        one = []
        for v in self.vectors:                       # grows while new vectors turn up
            row = []
            for s in range(SYMBOLS):
                c = before(s, v)
                least = min(c)
                c = tuple(x - least for x in c)
                if c not in self.number:
                    self.number[c] = len(self.vectors)
                    self.vectors.append(c)
                row.append((self.number[c], least))
            one.append(row)
        self.to = [[x[0] for x in row] for row in one]
        to, add = (np.array([[x[i] for x in row] for row in one], dtype=np.int64) for i in (0, 1))
        # blocks by composition: the last symbol of a block is taken first
        block_to = np.arange(len(one))[:, None]
        block_add = np.zeros_like(block_to)
        for _ in range(BLOCK):                       # a longer block has one more symbol in front
            block_add = (block_add[:, None, :] + add[block_to].transpose(0, 2, 1)).reshape(len(one), -1)
            block_to = to[block_to].transpose(0, 2, 1).reshape(len(one), -1)
        self.block_to, self.block_add = block_to.tolist(), block_add.tolist()
        self.traced = {}

    def step(self, sym: int, after: int, state: int) -> tuple[str, int]:
        """ASCII-least cheapest edits from a state up to and with this row, and the state they lead to."""
        v, edits = self.vectors[after], ""
        costs = before(sym, v)
        while True:
            if DELETE + v[state] == costs[state]:
                return edits + "D", state
            if INSERT + costs[NEXT[state]] == costs[state]:
                edits, state = edits + "I", NEXT[state]
                continue
            extra, kept = TRUNCATED * (sym & 1), kept_state(sym, state)
            if kept is not None and extra + v[kept] == costs[state]:
                return edits + "K", kept
            return edits + "R", NEXT[state]

    def trace(self, block: bytes, after: int, state: int) -> tuple[tuple, int]:
        """The edits of every row of a block and the state behind it; the vectors inside are expanded backward from ``after``."""
        key = block, after, state
        if key not in self.traced:
            inside = [after]
            for sym in reversed(block):
                inside.append(self.to[inside[-1]][sym])
            edits = []
            for sym, v in zip(block, reversed(inside[:-1])):
                e, state = self.step(sym, v, state)
                edits.append(e)
            self.traced[key] = tuple(edits), state
        return self.traced[key]

    def repair(self, symbols: bytes) -> tuple[int, list[str], str]:
        """Least cost, the edits of every row, and the rows inserted after the last one."""
        first = len(symbols) % BLOCK                 # the first block may be short, so that the others are whole
        v, cost, kept = 0, 0, []
        codes = np.frombuffer(symbols, dtype=np.uint8, offset=first).reshape(-1, BLOCK).astype(np.int64)
        codes = (codes @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist() if len(codes) else []
        for code in reversed(codes):
            kept.append(v)
            cost += self.block_add[v][code]
            v = self.block_to[v][code]
        start = v
        for sym in reversed(symbols[:first]):
            c = before(sym, self.vectors[v])
            cost += min(c)
            v = self.to[v][sym]
        cost += self.vectors[v][START]
        edits, state = [], START
        if first:
            e, state = self.trace(symbols[:first], start, state)
            edits += e
        for at, v in zip(range(first, len(symbols), BLOCK), reversed(kept)):
            e, state = self.trace(symbols[at:at + BLOCK], v, state)
            edits += e
        return cost, edits, "I" * (ENDS[state] // INSERT)


@functools.cache
def tables() -> Tables:
    return Tables()


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of ``conversations`` after the drawn damage: of 20 draws 0 drops a row, 1 empties its text, 2 removes its end marks,
    3 repeats it, 4 makes its role user."""
    own = rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                      F.coalesce("text", F.lit(" ")).alias("text"))
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = own.withColumn("draw", F.crc32(F.concat(as_text("conv"), F.lit(":"), as_text("turn"))) % 20).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.select("conv", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      F.when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _fault(earlier: Column) -> Column:
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return (F.when(last == "", "blank").when(earlier, "duplicate").when(~last.isin(".", "!", "?"), "truncated"))


def ordered_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of the rows (conv, turn, role, text, copies) in order: (conv, task, no, symbols, rows, first, last, illegal, blank,
    duplicate, truncated). ``rows`` has role and text of those that need not go."""
    rows = cut_lineage(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
                       .withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.reverse("text"))}), "rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (rows.groupBy("conv", "role", "t1", "t2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("c")).filter("c > 1")
             .withColumnsRenamed({"conv": "c0", "role": "r0", "t1": "x1", "t2": "x2"}))
    told = rows.join(again, F.col("conv").eqNullSafe(F.col("c0")) & (F.col("role") == F.col("r0")) & (F.col("t1") == F.col("x1"))
                     & (F.col("t2") == F.col("x2")), "left")
    later = F.col("at").isNotNull() & ~F.col("at").eqNullSafe(place)
    told = cut_lineage(told.select("conv", "turn", "role", "text", "copies", later.alias("later"), _fault(later).alias("fault")), "told")
    in_order = ("conv", F.col("turn").asc_nulls_first(), "role", "text")
    dealt = told.repartitionByRange(*in_order).sortWithinPartitions(*in_order)

    def cut(batches):
        task, made = TaskContext.get().partitionId(), 0
        conv, chunk = (), None
        done = []

        def close():
            nonlocal made
            if chunk is not None and chunk["symbols"]:
                done.append({**chunk, "conv": conv[0], "task": task, "no": made, "symbols": bytes(chunk["symbols"])})
                made += 1

        def fresh():
            return {"symbols": bytearray(), "rows": [], "first": None, "last": None, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0}

        def put(role, text, fault):
            nonlocal chunk
            if len(chunk["symbols"]) >= CHUNK_ROWS:
                close()
                chunk = fresh()
            initial = role[:1]
            if chunk["first"] is None:
                chunk["first"] = initial
            elif chunk["last"] + initial not in ("su", "ua", "au"):
                chunk["illegal"] += 1
            chunk["last"] = initial
            if fault:
                chunk[fault] += 1
            if fault in ("blank", "duplicate"):
                chunk["symbols"].append(GONE)
            else:
                chunk["symbols"].append(symbol(initial, fault == "truncated"))
                chunk["rows"].append({"role": role, "text": text})

        def table():
            out = pa.Table.from_pylist(done, CHUNK_SCHEMA).to_batches()
            done.clear()
            return out
        for b in batches:
            for c, role, text, copies, fault in zip(*(b.column(i).to_pylist() for i in range(5))):
                if not conv or conv[0] != c:
                    close()
                    conv, chunk = (c,), fresh()
                put(role, text, fault)
                for _ in range(copies - 1):
                    put(role, text, fault if fault == "blank" else "duplicate")
            yield from table()
        close()
        yield from table()

    return cut_lineage(dealt.select("conv", "role", "text", "copies", "fault").mapInArrow(cut, CHUNK_DDL), "chunks")


CHUNK_SCHEMA = pa.schema([("conv", pa.int64()), ("task", pa.int32()), ("no", pa.int64()), ("symbols", pa.binary()),
                          ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("first", pa.string()),
                          ("last", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                          ("truncated", pa.int64())])
CHUNK_DDL = ("conv long, task int, no long, symbols binary, rows array<struct<role:string,text:string>>, first string, last string, "
             "illegal long, blank long, duplicate long, truncated long")


def solved(chunks: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, plan): ``plan`` has (task, no, edits, state) of every chunk, with one
    comma-separated entry of edits a row and the rows inserted at the end as a last entry of the last chunk."""
    part = F.struct("task", "no", "symbols", "first", "last")
    by_conv = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(part)).alias("parts"),
                                         *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])

    def solve(batches):
        t = tables()
        for b in batches:
            out = []
            for r in b.to_pylist():
                parts = r.pop("parts")
                for x, y in itertools.pairwise(parts):
                    r["illegal"] += x["last"] + y["first"] not in ("su", "ua", "au")
                cost, edits, tail = t.repair(b"".join(p["symbols"] for p in parts))
                plan, at, state = [], 0, START
                for p in parts:
                    mine = edits[at:at + len(p["symbols"])]
                    at += len(mine)
                    plan.append({"task": p["task"], "no": p["no"], "edits": ",".join(mine), "tail": "", "state": state})
                    state = state_after(p["symbols"], mine, state)
                plan[-1]["tail"] = tail
                out.append({**r, "cost": cost, "audit": "".join(edits) + tail, "plan": plan})
            yield from pa.Table.from_pylist(out, SOLVED_SCHEMA).to_batches()

    return cut_lineage(by_conv.mapInArrow(solve, SOLVED_DDL), "solved")


SOLVED_SCHEMA = pa.schema([("conv", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                           ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                           ("plan", pa.list_(pa.struct([("task", pa.int32()), ("no", pa.int64()), ("edits", pa.string()),
                                                        ("tail", pa.string()), ("state", pa.int32())])))])
SOLVED_DDL = ("conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "plan array<struct<task:int,no:long,edits:string,tail:string,state:int>>")


def state_after(symbols: bytes, edits: list[str], state: int) -> int:
    for sym, e in zip(symbols, edits):
        for x in e:
            state = state if x == "D" else kept_state(sym, state) if x == "K" else NEXT[state]
    return state


def apply_edits(symbols: bytes, rows: list[dict], edits: str, tail: str, state: int) -> list[tuple[str, str]]:
    """The repaired (role, text) rows of a chunk."""
    out, rows = [], iter(rows)
    for sym, e in zip(symbols, edits.split(",")):
        row = next(rows) if sym != GONE else None
        for x in e:
            if x == "I":
                out.append((ROLES[state], ""))
                state = NEXT[state]
            elif x == "K":
                out.append((row["role"], row["text"]))
                state = kept_state(sym, state)
            elif x == "R":
                out.append((ROLES[state], row["text"]))
                state = NEXT[state]
    for _ in tail:
        out.append((ROLES[state], ""))
        state = NEXT[state]
    return out


def repaired(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, task, no, rows): the repaired rows of every chunk in order (some have none)."""
    plan = plans.select(F.col("conv").alias("c0"), F.explode("plan").alias("p")).select("c0", "p.*").withColumnsRenamed(
        {"task": "task0", "no": "no0"})
    both = chunks.select("conv", "task", "no", "symbols", "rows").join(
        plan, (F.col("task") == F.col("task0")) & (F.col("no") == F.col("no0")) & F.col("conv").eqNullSafe(F.col("c0")))

    def apply(batches):
        schema = pa.schema([CHUNK_SCHEMA.field(n) for n in ("conv", "task", "no", "rows")])
        for b in batches:
            out = [{"conv": r["conv"], "task": r["task"], "no": r["no"],
                    "rows": [{"role": x, "text": y} for x, y in apply_edits(r["symbols"], r["rows"], r["edits"], r["tail"], r["state"])]}
                   for r in b.to_pylist()]
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return both.select("conv", "task", "no", "symbols", "rows", "edits", "tail", "state").mapInArrow(
        apply, "conv long, task int, no long, rows array<struct<role:string,text:string>>")


def digests(fixed: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the repaired ``role:text`` rows joined by newlines; a conversation is read chunk by chunk."""
    import hashlib

    def digest(batches):
        conv, sha, any_row = (), None, False
        schema = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])
        out = []
        for b in batches:
            for c, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not conv or conv[0] != c:
                    if conv:
                        out.append({"conv": conv[0], "repaired_sha256": sha.hexdigest()})
                    conv, sha, any_row = (c,), hashlib.sha256(), False
                for r in rows:
                    sha.update(("\n" if any_row else "").encode() + f"{r['role']}:{r['text']}".encode())
                    any_row = True
            yield from pa.Table.from_pylist(out, schema).to_batches()
            out = []
        if conv:
            yield from pa.Table.from_pylist([{"conv": conv[0], "repaired_sha256": sha.hexdigest()}], schema).to_batches()

    in_order = fixed.repartition("conv").sortWithinPartitions("conv", "task", "no")
    return in_order.select("conv", "rows").mapInArrow(digest, "conv long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages the rows, repairs every conversation and reports on it: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""
    rows = damage(conversations)
    chunks = ordered_chunks(rows)
    plans = solved(chunks)
    fixed = digests(repaired(chunks, plans))
    turns = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"),
                                     F.count_distinct("turn").alias("turns"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = conversations.select(F.col("conv_id").alias("conv")).distinct()
    for i, side in enumerate((turns, plans.drop("plan"), fixed)):
        side = side.withColumnRenamed("conv", f"c{i}")
        out = out.join(side, F.col("conv").eqNullSafe(F.col(f"c{i}")), "left").drop(f"c{i}")
    return out.select(F.col("conv").alias("conv_id"), F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
                      *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
