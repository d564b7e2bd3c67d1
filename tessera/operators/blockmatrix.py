"""Sparse document-term matrices in row blocks, products with tall term tables, and truncated SVD (FEA-07, FEA-10).

A matrix is a table with one row a *block* of documents (compressed sparse rows over the block's own terms), written once. A *term table*
is a DataFrame (term, v) with one array of ``k`` numbers a term: right singular vectors, or the weights of ``k`` linear models. A pass over the
matrix joins each block with the term rows it needs (a list of them is kept), works out what the documents need in the task, and may
send back one row a term of the block, which are summed by term. So a pass moves (terms of a block) x k numbers a block
in each direction, not (entries) x k, and no term table ever reaches the driver: only k x k matrices do.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage, drop_table, freed_shuffles
from .common import dense_index

#: Bounds a block: a quarter of it in numbers of its term rows (200 MB), a fortieth of it in entries (30 MB).
WORK = 100_000_000
#: Numbers of a temporary product inside a task.
CHUNK = 4_000_000
#: Numbers that a pass may send each way at once (2 GB); beyond it the pass is made for ``NARROW`` columns at a time, whose files go before the next.
SENT, NARROW = 250_000_000, 16


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def to_lists(x: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))


def from_lists(column, k: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def block_rows(terms: DataFrame, entries: int, columns: int, share: int = 40) -> tuple[int, float]:
    """(blocks, term rows of all blocks) of a matrix whose terms have ``df`` entries each. Rows are spread over blocks by hash, so
    a term with df entries is in n (1 - (1 - 1 / n)^df) of n blocks; n is the smallest number that keeps a block within its bounds (a ``share``-th of
    ``WORK`` in entries)."""
    least = max(1, -(-entries * share // WORK), min(terms.sparkSession.sparkContext.defaultParallelism, entries // 250_000))
    sizes = [-(-least * f // 4) for f in (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096, 16384)]
    held = terms.agg(*[F.sum(1 - F.pow(F.lit(1.0 - 1.0 / n), F.col("df"))).alias(f"n{i}") for i, n in enumerate(sizes)]).first()     # one row
    for n, a in zip(sizes, held):
        if (a or 0.0) * columns <= WORK / 4:
            return n, n * (a or 0.0)
    n = max(sizes[-1], -(-entries * columns * 4 // WORK))
    return n, float(entries)


class Block:
    """One block in a task: ``ids``, ``meta`` (an array a name), ``terms`` (sorted), and products with dense matrices."""

    def __init__(self, row: dict, meta: tuple):
        self.ids, self.terms = row["ids"], np.asarray(row["terms"], dtype=np.int64)
        self.start, self.col, self.val = (np.asarray(row[c], dtype=t) for c, t in (("start", np.int64), ("col", np.int32), ("val", np.float64)))
        self.meta = dict(zip(meta, np.asarray(row["meta"], dtype=np.float64).reshape(len(meta), len(self.ids))))
        self.n = len(self.ids)

    @classmethod
    def read(cls, table: pa.Table, meta: tuple) -> "Block":
        """Of the one row of a table; only the ids become Python objects."""
        row = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("start", "col", "val", "terms", "meta")}
        return cls({**row, "ids": table.column("ids")[0].as_py()}, meta)

    @staticmethod
    def _sums(pick, at, val, x, bounds, out):
        """out[i] = sum over entries bounds[i]:bounds[i+1] of val * x[at], a bounded number of entries at a time."""
        full = np.flatnonzero(np.diff(bounds))
        step = max(1, CHUNK // max(1, x.shape[1]))
        i = 0
        while i < len(full):
            j = max(i + 1, int(np.searchsorted(bounds[full + 1], bounds[full[i]] + step, "right")))
            s, e = bounds[full[i]], bounds[full[j - 1] + 1]
            seg = x[at[pick[s:e]] if pick is not None else at[s:e]] * (val[pick[s:e]] if pick is not None else val[s:e])[:, None]
            out[full[i:j]] = np.add.reduceat(seg, bounds[full[i:j]] - s, axis=0)
            i = j
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """X v: one row a document."""
        return self._sums(None, self.col, self.val, v, self.start, np.zeros((self.n, v.shape[1])))

    @functools.cached_property
    def _by_term(self) -> tuple:
        """The entries in the order of their terms, their documents, and where each term begins."""
        bounds = np.concatenate(([0], np.cumsum(np.bincount(self.col, minlength=len(self.terms)))))
        return np.argsort(self.col, kind="stable").astype(np.int32), np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.start)), bounds

    def transposed_times(self, d: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """X' d: one row a term of the block; of the terms ``only`` (true or false), the others' rows are 0."""
        order, doc, bounds = self._by_term
        if only is not None:
            order = order[np.repeat(only, np.diff(bounds))]
            bounds = np.concatenate(([0], np.cumsum(np.where(only, np.diff(bounds), 0))))
        return self._sums(order, doc, self.val, d, bounds, np.zeros((len(self.terms), d.shape[1])))


class BlockMatrix:
    """A document-term matrix in blocks: ``blocks`` (one row each) and ``asked`` (block, term)."""

    def __init__(self, blocks: DataFrame, id_type: str, meta: tuple, parts: int = 1):
        self.blocks, self.id_type, self.meta, self.parts, self.narrow = blocks, id_type, meta, parts, 0
        self.asked = cut_lineage(blocks.select("block", F.explode("terms").alias("term")), "asked")

    @classmethod
    def build(cls, weights: DataFrame, docs: DataFrame, columns: int, id_col: str = "doc_id", index_col: str = "term_index",
              value_col: str = "weight", meta: tuple = (), parts: int = 1, part=None, share: int = 40) -> "BlockMatrix":
        """``weights``: (id, index, value) entries; ``docs``: every document once, with numeric ``meta`` columns; ``columns``: how wide
        the term tables will be, which sets the size of a block. With ``parts`` the documents of a block are of one part: ``part`` is a function of
        the meta arrays that gives 0..parts-1, and the part is the block's number modulo ``parts``."""
        n, _ = block_rows(weights.groupBy(index_col).agg(F.count(F.lit(1)).alias("df")), weights.count(), columns, share)
        id_type = docs.schema[id_col].dataType.simpleString()
        block = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block")
        left = weights.select(block, F.col(id_col).alias("id"), F.col(index_col).cast("long").alias("term"), F.col(value_col).cast("double").alias("v"))
        right = docs.select(block, F.col(id_col).alias("id"), *[F.col(m).cast("double").alias(m) for m in meta])

        def one(x, kind):
            """A column of one row; lists are taken over from arrays as they are."""
            if not pa.types.is_list(kind):
                return pa.array([x], kind)
            x = x.cast(kind.value_type) if isinstance(x, pa.Array) else pa.array(x, kind.value_type)
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(kind)

        def pack(entries, docs):
            if not docs.num_rows:
                return pa.table([pa.array([], f.type) for f in schema], schema=schema)
            ids = docs.column("id").combine_chunks()
            doc = pc.fill_null(pc.index_in(entries.column("id"), value_set=ids), -1).to_numpy() if entries.num_rows else np.empty(0, dtype=np.int32)
            about = np.array([docs.column(m).to_numpy() for m in meta]).reshape(len(meta), len(ids))
            which = part(dict(zip(meta, about))) if parts > 1 else np.zeros(len(ids), dtype=np.int64)
            number, rows = docs.column("block")[0].as_py() * parts, []
            order = np.argsort(doc, kind="stable").astype(np.int32)          # entries of no document come first and are left out
            order = order[int((doc < 0).sum()):]
            for p in np.unique(which):
                mine = np.flatnonzero(which == p)
                own = order[which[doc[order]] == p] if parts > 1 else order
                term = entries.column("term").to_numpy()[own]
                terms = np.unique(term)
                col = np.searchsorted(terms, term).astype(np.int32)
                start = np.concatenate(([0], np.cumsum(np.bincount(doc[own], minlength=len(ids))[mine])))
                row = [number + int(p), ids.take(pa.array(mine)), start, col, entries.column("v").to_numpy()[own], terms, about[:, mine].ravel()]
                rows.append(pa.table([one(x, f.type) for x, f in zip(row, schema)], schema=schema))
            return pa.concat_tables(rows)

        ddl = f"block int, ids array<{id_type}>, start array<int>, col array<int>, val array<double>, terms array<bigint>, meta array<double>"
        schema = arrow_schema(ddl)
        packed = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(pack, ddl)
        return cls(cut_lineage(packed, "matrix"), id_type, meta, parts)

    def _pass(self, v: DataFrame | None, k: int, body, ddl: str) -> DataFrame:
        meta = self.meta

        def run(blocks, rows):
            block = Block.read(blocks, meta)
            x = np.zeros((len(block.terms), k))
            if rows.num_rows:
                at = np.searchsorted(block.terms, rows.column("term").to_numpy())
                if slotted:
                    v = rows.column("v").combine_chunks()
                    v = from_lists(v, len(v[0]))
                    x.reshape(len(x), -1, v.shape[1])[at, rows.column("slot").to_numpy()] = v
                else:
                    x[at] = from_lists(rows.column("v"), k)
            return body(block, x)

        asked, keys, slotted = self.asked, ["term"], v is not None and "slot" in v.columns      # slot: which of the equal stretches of the columns a row has
        if v is not None and "part" in v.columns:           # rows of a block's own part
            asked, keys = asked.withColumn("part", F.col("block") % self.parts), ["term", "part"]
        needed = (asked.join(v, keys) if v is not None else self.asked.select("block", "term", F.array().cast("array<double>").alias("v"))
                  .filter(F.lit(False)))
        return self.blocks.groupBy("block").cogroup(needed.select("block", "term", "v", *["slot"] * slotted).groupBy("block")).applyInArrow(run, ddl)

    def documents(self, v: DataFrame | None, k: int, per_document, ddl: str, names: list[str], prepare=None) -> DataFrame:
        """Rows that ``per_document(block, X v)`` gives: a list of Arrow columns called ``names``. ``prepare(block, v)`` may work out the
        columns to multiply with from the term rows that were sent."""
        schema = arrow_schema(ddl)
        ready = prepare or (lambda block, x: x)
        return self._pass(v, k, lambda block, x: pa.table(per_document(block, block.times(ready(block, x))), names=names).cast(schema), ddl)

    def back(self, v: DataFrame | None, k: int, per_document, width: int) -> DataFrame:
        """(term, v): X' D, where ``per_document(block, X v)`` gives D with ``width`` columns; written as a term table."""
        def body(block, x):
            z = block.transposed_times(per_document(block, block.times(x)))
            return pa.table([pa.array(block.terms), to_lists(z)], names=["term", "v"])
        return cut_lineage(sum_by_term(self._pass(v, k, body, "term long, v array<double>"), width), "term-table")

    def square(self, v: DataFrame, k: int, turn: np.ndarray | None = None) -> DataFrame:
        """(term, v): X'X V, or X'X V R with ``turn`` R. A narrow matrix (``narrow``) is multiplied with a few columns at a time."""
        return self._columns(turn.shape[1] if turn is not None else k, lambda c, own: self.back(
            (v if own == k else narrowed(v, c, own)) if turn is None else rotate(v, turn[:, c:c + own]), own, lambda block, y: y, own))

    def _columns(self, k: int, some) -> DataFrame:
        """A table (term, v) of ``k`` columns from ``some(first, number)`` for all of them, or for a few at a time if the matrix is narrow."""
        if not self.narrow or k <= self.narrow:
            return some(0, k)
        parts = [some(c, min(self.narrow, k - c)) for c in range(0, k, self.narrow)]
        named = [t.select("term", F.col("v").alias(f"v{i}")) for i, t in enumerate(parts)]
        out = cut_lineage(functools.reduce(lambda a, b: a.join(b, "term"), named).select("term", F.concat(*[f"v{i}" for i in range(len(parts))]).alias("v")), "term-table")
        for t in parts:
            drop_table(t)
        return out

    def drop(self) -> None:
        """Deletes the tables, when nothing reads them any more."""
        drop_table(self.blocks)
        drop_table(self.asked)

    def terms(self) -> DataFrame:
        return self.asked.select("term").distinct()


def sum_by_term(rows: DataFrame, k: int) -> DataFrame:
    """Sums of the arrays of each term, as a stream over rows sorted by term: memory does not grow with the blocks a term is in."""
    def run(batches):
        last, total = None, None
        for b in batches:
            if not b.num_rows:
                continue
            term, x = b.column(0).to_numpy(), from_lists(b.column(1), k)
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            names, sums = term[first], np.add.reduceat(x, first, axis=0)
            if last is not None and names[0] == last:
                sums[0] += total
            elif last is not None:
                yield pa.record_batch([pa.array([last], pa.int64()), to_lists(total[None, :])], names=["term", "v"])
            last, total = int(names[-1]), sums[-1].copy()
            if len(names) > 1:
                yield pa.record_batch([pa.array(names[:-1]), to_lists(sums[:-1])], names=["term", "v"])
        if last is not None:
            yield pa.record_batch([pa.array([last], pa.int64()), to_lists(total[None, :])], names=["term", "v"])

    return rows.repartition("term").sortWithinPartitions("term").mapInArrow(run, "term long, v array<double>")


def gram(rows: DataFrame, k: int) -> np.ndarray:
    """V' V over all rows (v): k rows of k numbers reach the driver."""
    def part(batches):
        total = np.zeros((k, k))
        for b in batches:
            x = from_lists(b.column(0), k)
            total += x.T @ x
        yield pa.record_batch([pa.array(range(k), pa.int32()), to_lists(total)], names=["i", "v"])

    def add(key, table):
        return pa.table([pa.array([key[0].as_py()], pa.int32()), to_lists(from_lists(table.column("v"), k).sum(axis=0)[None, :])], names=["i", "v"])

    ddl = "i int, v array<double>"
    out = np.zeros((k, k))
    with freed_shuffles(rows.sparkSession):
        for r in rows.select("v").mapInArrow(part, ddl).groupBy("i").applyInArrow(add, ddl).collect():
            out[r.i] = r.v
    return out


def rotate(rows: DataFrame, r: np.ndarray) -> DataFrame:
    """(term, v r): each row times a small matrix."""
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), to_lists(from_lists(b.column(1), r.shape[0]) @ r)], names=["term", "v"])
    return rows.select("term", "v").mapInArrow(run, "term long, v array<double>")


def narrowed(rows: DataFrame, first: int, number: int) -> DataFrame:
    """(term, v) with some of the columns."""
    return rows.select("term", F.slice("v", first + 1, number).alias("v"))


def _whitener(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R with (V R)'(V R) = 1 for V'V = g, largest directions first, and the eigenvalues; directions without extent are left out."""
    values, vectors = np.linalg.eigh(g)
    keep = values > max(values[-1], 0.0) * 1e-13
    values, vectors = values[keep][::-1], vectors[:, keep][:, ::-1]
    return vectors / np.sqrt(values), values


def normal_numbers(term: np.ndarray, k: int, seed: int, columns: slice = slice(None)) -> np.ndarray:
    """A row of ``k`` normal random numbers a term that depend on term and seed alone; of it, the given columns."""
    u = np.uint64

    def mix(x):
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
        return x ^ (x >> u(31))
    at = np.arange(2 * k, dtype=np.uint64).reshape(2, k)[:, columns].ravel()
    cells = term.astype(np.uint64)[:, None] * u(2 * k) + at[None, :]
    h = (mix(mix(cells + u(seed)) + u(0x9E3779B97F4A7C15)) >> u(11)).astype(np.float64) / 2**53
    k = len(at) // 2
    return np.sqrt(-2 * np.log(1 - h[:, :k])) * np.cos(2 * np.pi * h[:, k:])


def normal_rows(terms: DataFrame, k: int, seed: int) -> DataFrame:
    """(term, v) with ``normal_numbers``."""
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), to_lists(normal_numbers(b.column(0).to_numpy(), k, seed))], names=["term", "v"])
    return terms.mapInArrow(run, "term long, v array<double>")


def truncated_svd(matrix: BlockMatrix, k: int, oversample: int = 10, max_iter: int = 8, tol: float = 1e-4, seed: int = 7):
    """Truncated SVD without centring by block subspace iteration: (V as a term table of ``k`` columns, singular values).

    Each round multiplies an orthonormal term table with X'X in one pass and makes the product orthonormal again with its Gram matrix. It ends when
    no singular value moves by more than ``tol`` of the largest one, or after ``max_iter`` rounds; the last table is turned to the singular
    directions by the Gram matrix of X V. Fewer than ``k`` columns come out when the matrix has a smaller rank. The
    sign of a column makes its largest entry positive.
    """
    p = k + oversample
    v = cut_lineage(normal_rows(matrix.terms(), p, seed), "term-table")
    g = gram(v, p)
    if not g.any():
        return rotate(v, np.zeros((p, 0))), []
    before = None
    for _ in range(max_iter):
        r, values = _whitener(g)
        past, p = v, r.shape[1]
        v = matrix.square(past, r.shape[0], r)
        drop_table(past)
        g = gram(v, p)
        now = np.sort(np.sqrt(np.sqrt(np.maximum(np.linalg.eigvalsh(g), 0))))[::-1][:k]
        if before is not None and len(now) == len(before) and np.abs(now - before).max() <= tol * now[0]:
            break
        before = now
    for _ in range(2):                                      # twice, so that rounding in the first Gram matrix is made good
        r, _ = _whitener(g)
        past, v = v, cut_lineage(rotate(v, r), "term-table")
        drop_table(past)
        p = r.shape[1]
        g = gram(v, p)
    if matrix.narrow:
        values, turn = np.linalg.eigh(_mixed_gram(v, matrix.square(v, p), p))
    else:
        y = matrix.documents(v, p, lambda block, y: [to_lists(y)], "v array<double>", ["v"])
        values, turn = np.linalg.eigh(gram(y, p))
    order = np.argsort(-values)[:k]
    table, v = v, rotate(v, turn[:, order])
    largest = (v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.max_by("x", F.struct(F.abs("x"), "x")).alias("x")).collect())
    sign = np.ones(len(order))
    for r in largest:                                       # k rows
        sign[r.i] = -1.0 if r.x < 0 else 1.0
    v = cut_lineage(rotate(v, np.diag(sign)), "components")
    drop_table(table)
    return v, [float(np.sqrt(max(values[i], 0.0))) for i in order]


def _mixed_gram(v: DataFrame, z: DataFrame, p: int) -> np.ndarray:
    """V'Z, made symmetric: (X V)'(X V) for Z = X'X V."""
    both = gram(v.join(z.withColumnRenamed("v", "z"), "term").select(F.concat("v", "z").alias("v")), 2 * p)
    drop_table(z)
    return (both[:p, p:] + both[p:, :p]) / 2


def decompose(weights: DataFrame, docs: DataFrame, k: int, oversample: int = 10, seed: int = 7, id_col: str = "doc_id"):
    """Truncated SVD of (id, term_index, weight): (documents X V, V as a term table, singular values), as ``truncated_svd`` and ``project`` give them.

    The rows that travel are those of terms in blocks of documents, or of documents in blocks of terms; whichever are fewer."""
    entries, p = weights.count(), k + oversample
    by_term, by_doc = (block_rows(weights.groupBy(c).agg(F.count(F.lit(1)).alias("df")), entries, p)[1] for c in ("term_index", id_col))
    narrow = NARROW if min(by_term, by_doc) * p > SENT else 0
    found = transposed_svd(weights, docs, k, oversample, seed=seed, id_col=id_col, narrow=narrow) if by_doc < by_term else None
    if found is None:
        matrix = BlockMatrix.build(weights, docs, narrow or p, id_col, share=20 if narrow else 40)
        matrix.narrow = narrow
        v, s = truncated_svd(matrix, k, oversample, seed=seed)
        found = project(matrix, v, len(s), id_col), v, s
    return found


def transposed_svd(weights: DataFrame, docs: DataFrame, k: int, oversample: int = 10, max_iter: int = 8, tol: float = 1e-4, seed: int = 7,
                   id_col: str = "doc_id", narrow: int = 0):
    """The same iteration from the same start, kept as Y = X V on documents: a round is Y <- X X' Y over blocks of terms, and only rows of documents travel.

    With W an orthonormal basis of Y, Z = X X' W, A = W'Z and B = Z'Z, the columns X'W A^-1/2 are the orthonormal term table of that round, so its singular
    directions come from A^-1/2 B A^-1/2 and X V = Z A^-1/2 turned by them. None if there is nothing to decompose."""
    spread = F.pmod(F.xxhash64(id_col), F.lit(1024))
    rows = cut_lineage(dense_index(docs.select(id_col).distinct(), id_col, "row", order=[(spread, True), (F.col(id_col), True)], buckets=[(spread, True)]), "rows")
    number = rows.select(F.col(id_col).alias("_id"), "row")
    entries = cut_lineage(weights.join(number, F.col(id_col).eqNullSafe(F.col("_id"))).select("term_index", "row", "weight"), "by-term")
    p = k + oversample
    matrix = BlockMatrix.build(entries, entries.select("term_index").distinct(), narrow or p, "term_index", "row", share=20 if narrow else 40)
    matrix.narrow = narrow
    drop_table(entries)
    y = matrix._columns(p, lambda c, own, p=p: matrix.back(None, 0, lambda block, _: normal_numbers(np.asarray(block.ids, dtype=np.int64), p, seed, slice(c, c + own)), own))
    r, _ = _whitener(gram(y, p)) if not y.isEmpty() else (np.zeros((p, 0)), None)
    if not r.size:
        return None
    before, turned, w = None, None, None
    for _ in range(max_iter):
        past, w, p = (w, y), cut_lineage(rotate(y, r), "term-table"), r.shape[1]
        for t in past:
            if t is not None:
                drop_table(t)
        y = matrix.square(w, p)
        both = gram(w.join(y.withColumnRenamed("v", "z"), "term").select(F.concat("v", "z").alias("v")), 2 * p)
        a, b = (both[:p, p:] + both[p:, :p]) / 2, both[p:, p:]
        if turned is not None:
            now = np.sort(np.sqrt(np.sqrt(np.maximum(np.linalg.eigvalsh(turned.T @ a @ turned), 0))))[::-1][:k]
            if before is not None and len(now) == len(before) and np.abs(now - before).max() <= tol * now[0]:
                break
            before = now
        half, _ = _whitener(a)
        r, _ = _whitener(b)
        turned = np.linalg.pinv(r) @ half
    half, _ = _whitener(a)
    values, turn = np.linalg.eigh(half.T @ b @ half)
    order = np.argsort(-values)[:k]
    final, size = half @ turn[:, order], len(order)

    def ends(block, y):
        x = y @ final
        return [pa.array(np.tile(np.arange(size, dtype=np.int32), 2)), pa.array(np.concatenate([x.max(axis=0), x.min(axis=0)]))]
    if narrow:                                              # V = X' W F by columns of F
        v = matrix._columns(size, lambda c, own: cut_lineage(matrix.documents(
            rotate(w, final[:, c:c + own]), own, lambda block, y: [pa.array(block.ids, pa.int64()), to_lists(y)], "term long, v array<double>", ["term", "v"]), "term-table"))
        extremes = v.select(F.posexplode("v").alias("i", "x"))
    else:
        extremes = matrix.documents(w, p, ends, "i int, x double", ["i", "x"])
    sign = np.ones(size)
    for row in extremes.groupBy("i").agg(F.max_by("x", F.struct(F.abs("x"), "x")).alias("x")).collect():      # k rows
        sign[row.i] = -1.0 if row.x < 0 else 1.0
    final = final * sign
    if narrow:
        v = rotate(v, np.diag(sign))
    else:
        v = matrix.documents(w, p, lambda block, y: [pa.array(block.ids, pa.int64()), to_lists(y @ final)], "term long, v array<double>", ["term", "v"])
    # a document that is listed more than once has its values once and otherwise none
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(id_col)).alias("_n")
    listed = docs.select(id_col, first).join(number, (F.col(id_col).eqNullSafe(F.col("_id"))) & (F.col("_n") == 1), "left")
    x = listed.join(rotate(y, final).withColumnRenamed("term", "row"), "row", "left").select(id_col, F.coalesce("v", F.array_repeat(F.lit(0.0), size)).alias("v"))
    x = cut_lineage(x, "projected")
    for t in (y, rows):
        drop_table(t)
    return x.select(id_col, F.posexplode("v").alias("component", "value")), v, [float(np.sqrt(max(values[i], 0.0))) for i in order]


def project(matrix: BlockMatrix, v: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """(id, component, value) for every document and component: X V."""
    def rows(block, y):
        return [pa.array(block.ids), to_lists(y)]
    step, ddl = matrix.narrow or max(1, k), f"id {matrix.id_type}, v array<double>"
    parts = []
    for c in range(0, max(1, k), step):
        own = min(step, k - c)
        out = matrix.documents(v if own == k else narrowed(v, c, own), own, rows, ddl, ["id", "v"]).select(F.col("id").alias(id_col), F.posexplode("v").alias("component", "value"))
        parts.append(out if not c else out.withColumn("component", F.col("component") + c))
    return functools.reduce(DataFrame.unionByName, parts)
