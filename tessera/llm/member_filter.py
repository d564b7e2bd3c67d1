"""A Bloom filter of fixed size, to leave out most rows that have no partner before their texts are shuffled for a join.

The filter has ``BITS`` bits (8 MB) whatever the number of ids, so it is safe to broadcast; with many ids it lets more
rows through, and the join that follows stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U, mix

BITS = 26
WIDE_BITS = 27
SLICES = 64
HASHES = 4


def _places(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + U(0x9E3779B97F4A7C15))
    return [(mix(h + U(i)) >> U(64 - BITS)).astype(np.int64) for i in range(HASHES)]


def member_filter(ids: DataFrame):
    """Broadcast filter over the first column (a long) of ``ids``."""
    part = (1 << BITS) // SLICES

    def fill(batches):
        bits = np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            x = b.column(0).drop_null().to_numpy()
            for p in _places(x):
                bits[p] = True
        used = [i for i in range(SLICES) if bits[i * part:(i + 1) * part].any()]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([np.packbits(bits[i * part:(i + 1) * part]).tobytes() for i in used],
                                                                    pa.binary())], names=["slice", "bits"])

    def join(key, table):
        bits = np.zeros(part // 8, dtype=np.uint8)
        for x in table.column("bits").to_pylist():
            bits |= np.frombuffer(x, dtype=np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = ids.mapInArrow(fill, "slice int, bits binary").groupBy("slice").applyInArrow(join, "slice int, bits binary").collect()
    bits = np.zeros(1 << BITS, dtype=np.uint8).reshape(SLICES, part)[:, :part // 8].copy()
    for r in rows:
        bits[r.slice] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits.ravel())


def maybe_among(df: DataFrame, id_col: str, shared) -> DataFrame:
    """Rows whose id passes the filter: all that are among the ids and few others."""
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def run(batches):
        for b in batches:
            ids = b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            x = ids.fill_null(0).to_numpy()
            keep = known.copy()
            for p in _places(x):
                keep &= (shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
            yield pa.record_batch([b.column(1).filter(pa.array(keep))], names=["row"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")


def repeated_filter(values: DataFrame):
    """Broadcast filter (16 MB) over the first column (arrays of longs): passes every value that occurs twice or more in the
    rows, and a few others. Two bits a place while it is filled: met once, met again."""
    size = 1 << WIDE_BITS
    part = size // 8 // SLICES

    def fill(batches):
        once, again = np.zeros(size // 8, dtype=np.uint8), np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            p, n = np.unique(_wide(b.column(0).flatten().to_numpy()), return_counts=True)
            byte, bit = p >> 3, (128 >> (p & 7)).astype(np.uint8)
            met = (once[byte] & bit > 0) | (n > 1)
            np.bitwise_or.at(again, byte[met], bit[met])
            np.bitwise_or.at(once, byte, bit)
        pack = lambda x, i: pa.compress(x[i * part:(i + 1) * part].tobytes(), "zstd", asbytes=True)
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([pack(once, i) for i in range(SLICES)], pa.binary()),
                               pa.array([pack(again, i) for i in range(SLICES)], pa.binary())], names=["slice", "once", "again"])

    def join(key, table):
        once, again = np.zeros(part, dtype=np.uint8), np.zeros(part, dtype=np.uint8)
        read = lambda x: np.frombuffer(pa.decompress(x, part, "zstd"), dtype=np.uint8)
        for x, y in zip(table.column("once").to_pylist(), table.column("again").to_pylist()):
            x = read(x)
            again |= read(y) | (once & x)
            once |= x
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([again.tobytes()], pa.binary())})

    rows = (values.mapInArrow(fill, "slice int, once binary, again binary").groupBy("slice")
            .applyInArrow(join, "slice int, bits binary").collect())
    bits = np.zeros((SLICES, part), dtype=np.uint8)
    for r in rows:
        bits[r.slice] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return values.sparkSession.sparkContext.broadcast(bits.ravel())


def _wide(values: np.ndarray) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64) + U(0xD6E8FEB86659FD93)) >> U(64 - WIDE_BITS)).astype(np.int64)


def maybe_repeated(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    p = _wide(values)
    return bits[p >> 3] & (128 >> (p & 7)).astype(np.uint8) > 0
