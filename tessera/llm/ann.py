"""Approximate nearest neighbours by multi-index hashing.

*Codes.* On a bounded sample (``sample_rows`` vectors drawn by a hash of the id) a principal-component projection of the
normalised vectors and a rotation that brings it close to the corners of a cube (iterative quantisation) are learned;
signs give each vector its binary code. *Radius.* Also on the sample, the Hamming radius is set that holds the share
``hold`` of true nearest neighbours; neighbours in all rows are nearer than those in a sample, so it errs upwards.

*Index.* Codes are split into 8-bit substrings. Each batch of rows keeps, for every substring, its rows sorted by
that substring's value. *Search.* By the pigeonhole principle a code within radius r of a query differs in some substring i by at most
r_i, if the r_i + 1 add up to r + 1; so probing all values within r_i in each substring retrieves every code
within the radius. What is retrieved and within the radius is reranked on the original vectors in double precision. Where a
batch has fewer codes than asked for within the radius, its nearest codes are taken.

Every row is indexed, none is shuffled. Queries are taken block by block (``query_block`` at a time, by a hash, one
broadcast each) against all rows; a task hands on the best of its rows for each query. Equal vectors are
searched once: of those in a batch only the least ids can be among the nearest, and equal queries share one search.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part; fewer candidates than k are all returned; ties go to the smaller id; rows with a query's own id are not its
candidates; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import top_k_per_group

FOUND = "query long, vec long, score double"


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray           # dimensions x bits
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.turn > 0, axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def learn(x: np.ndarray, bits: int, k: int, hold: float, steps: int = 30, seed: int = 5) -> Coder:
    """Projection, rotation and radius from sample vectors (rows)."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    bits = max(8, min(bits, x.shape[1]) // 8 * 8)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    project = vectors[:, ::-1][:, :bits]
    if project.shape[1] < bits:
        project = np.pad(project, ((0, 0), (0, bits - project.shape[1])))
    v = centred @ project
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(steps):
        a, _, b = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (a @ b).T
    coder = Coder(mean, project @ turn, bits)
    if len(x) > k:
        asked = np.random.default_rng(seed).permutation(len(x))[:500]
        near = unit[asked] @ unit.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        code = coder.codes(x)
        coder.radius = int(np.quantile(distance(code[asked][:, None], code[best]), hold, method="higher"))
    return coder


def budgets(radius: int, parts: int) -> list[int]:
    """r_i with sum(r_i + 1) = radius + 1, as even as they can be; -1: the substring needs no probe."""
    return [(radius + 1) // parts - 1 + (i < (radius + 1) % parts) for i in range(parts)]


MASKS = [np.array([m for m in range(256) if bin(m).count("1") <= r], dtype=np.uint8) for r in range(9)]


class Tables:
    """The multi-index over one batch of distinct vectors."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, i], kind="stable") for i in range(codes.shape[1])]
        self.edge = [np.searchsorted(codes[o, i], np.arange(257)) for i, o in enumerate(self.order)]

    def within(self, query: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows whose code is within the radius; the ``least`` nearest if there are fewer."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for i, r in enumerate(budgets(radius, self.codes.shape[1])):
            if r >= 0:
                values = query[i] ^ MASKS[min(r, 8)]
                s, e = self.edge[i][values], self.edge[i][values.astype(np.int64) + 1]
                n = e - s
                hit[self.order[i][np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(hit)
        rows = rows[distance(self.codes[rows], query) <= radius]
        if len(rows) < least:
            d = distance(self.codes, query)
            rows = np.argsort(d, kind="stable")[:least]
        return rows


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row with one order of summation, so that equal vectors get equal scores."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def nearest(vectors: DataFrame, asked: Column, k: int = 5, bits: int = 64, hold: float = 0.97, sample_rows: int = 20_000,
            query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row where ``asked`` (a condition on the id column)."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = (usable(vectors, id_col, vector_col).groupBy(F.size("v").alias("size")).count()
            .orderBy(F.desc("count"), "size").first())
    if size is None:
        return empty
    size, total = size["size"], size["count"]
    rows = usable(vectors, id_col, vector_col).filter(F.size("v") == size)
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    sample = rows.filter(place < int((1 << 30) * min(1.0, sample_rows / total))).select("v").toArrow()
    if not sample.num_rows:
        sample = rows.limit(1).select("v").toArrow()
    coder = learn(_matrix(sample.column(0).combine_chunks(), size), bits, k, hold)
    marked = (vectors.filter(asked & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct())
    queries = rows.join(marked, "id", "left_semi")
    count = queries.count()
    blocks = max(1, -(-count // query_block))
    out = []
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(blocks)) == b).toArrow()   # one block, by hash
        if not block.num_rows:
            continue
        ids = block.column("id").to_numpy()
        x = _matrix(block.column("v").combine_chunks(), size)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        distinct, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
        shared = spark.sparkContext.broadcast((coder, ids[first], distinct, coder.codes(distinct)))
        found = rows.mapInArrow(_search(shared, k, size), FOUND)
        best = top_k_per_group(found, "query", [F.desc("score"), F.asc("vec")], k + 1, salt_col="vec", rank_col="place")
        names = spark.createDataFrame(pa.table({"query": ids[first][which.ravel()], "query_id": ids}))
        out.append(best.join(names.distinct(), "query").filter("vec <> query_id").select("query_id", "vec", "score"))
    if not out:
        return empty
    result = out[0]
    for other in out[1:]:
        result = result.unionByName(other)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")           # k + 1 rows a query
    return (result.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vec").alias("vec_id"), "score"))


def _search(shared, k: int, size: int):
    def run(batches):
        coder, names, queries, codes = shared.value
        best_score = np.full((len(names), k + 1), -np.inf)
        best_id = np.zeros((len(names), k + 1), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), size)
            order = np.lexsort((ids, *x.T[:4]))
            ids, x = ids[order], x[order]
            # equal vectors in a batch: only the k + 1 least ids can be among the nearest
            _, group = np.unique(x, axis=0, return_inverse=True)
            group = group.ravel()
            order = np.lexsort((ids, group))
            ids, x, group = ids[order], x[order], group[order]
            start = np.searchsorted(group, group)
            keep = np.arange(len(ids)) - start <= k
            ids, x = ids[keep], x[keep]
            tables = Tables(coder.codes(x))
            for i in range(len(names)):
                rows = tables.within(codes[i], coder.radius, k + 1)
                score = np.append(best_score[i], cosine(x[rows], queries[i]))
                near = np.append(best_id[i], ids[rows])
                top = np.lexsort((near, -score))[:k + 1]
                best_score[i], best_id[i] = score[top], near[top]
        real = np.isfinite(best_score)
        yield pa.record_batch([pa.array(np.repeat(names, k + 1)[real.ravel()]), pa.array(best_id[real]), pa.array(best_score[real])],
                              names=["query", "vec", "score"])
    return run
