"""Blocked key lookups: the shuffle shared by the operators that must look every word n-gram up.

Documents are dealt to blocks by a hash of their id. A block turns its words into 64-bit keys, keeps each
distinct key once and sends its sorted keys, range by range, to key buckets. A bucket merges the keys of all
blocks and answers every block in that block's own key order, so an answer needs no key again. A key
that occurs everywhere costs one entry per block, never one row per occurrence, and no task sees more
than one block or one key range. The block count follows the bytes of text, so block and bucket sizes do not
grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
MIX1, MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: Most words a worker keeps the hashes of; beyond it the table starts afresh (a cache, not a limit on words).
CACHE_WORDS = 200_000
#: Text in a block. A block sends one row to each key range, as many as there are blocks: a larger input may want
#: larger blocks (and workers with the memory for them), so that these rows stay long.
BLOCK_BYTES = 6_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that sums of word hashes spread over the whole range."""
    x = x ^ (x >> U(33))
    x = x * MIX1
    x = x ^ (x >> U(33))
    x = x * MIX2
    return x ^ (x >> U(33))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Unmixed polynomial hash of every ``k`` consecutive entries (mod 2**64), by doubling."""
    if k < 1 or len(h) < k:
        return np.empty(0, dtype=np.uint64)
    out, width, power = None, 0, base
    piece, size = h, 1                       # piece[i]: hash of `size` entries from i; power: base**size
    acc_len = len(h)
    while k:
        if k & 1:
            if out is None:
                out, width = piece, size
            else:                            # out covers `width` entries, followed by `piece`
                n = acc_len - (width + size) + 1
                out = out[:n] * U(power) + piece[width:width + n]
                width += size
        k >>= 1
        if k:
            n = acc_len - 2 * size + 1
            piece = piece[:n] * U(power) + piece[size:size + n]
            power = power * power % 2**64
            size *= 2
    return out


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every ``w`` consecutive entries, by doubling."""
    n, size = len(x), 1
    if n < w:
        return x[:0]
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return x if size == w else f(x[:n - w + 1], x[w - size:w - size + n - w + 1])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as fixed-width differences, in as few bytes each as the largest needs."""
    if not len(keys):
        return b""
    d = np.empty_like(keys)
    d[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=d[1:])
    width = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(keys) > 1 else 1
    return bytes([width]) + keys[:1].tobytes() + d[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, dtype=np.uint64)
    width = b[0]
    raw = np.frombuffer(b, dtype=np.uint8, offset=9).reshape(-1, width)
    d = np.zeros((len(raw) + 1, 8), dtype=np.uint8)
    d[1:, :width] = raw
    d = d.view(np.uint64).ravel()
    d[0] = np.frombuffer(b, dtype=np.uint64, count=1, offset=1)[0]
    return np.cumsum(d, dtype=np.uint64)


def bounds(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the key space begins and ends in the sorted keys."""
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, cuts), [len(sorted_keys)])).astype(np.int64)


def block_count(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` of text: one count over the text column, so the number follows the data alone."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0]
    return max(1, -(-(total or 0) // block_bytes))


def in_blocks(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text",
              extra: tuple = (), deal: tuple = ()) -> DataFrame:
    """(block, part): the rows (doc, text, ...) of each block, a null text read as empty, in compressed parts. Rows are dealt by
    their id and the columns named in ``deal``.

    A part holds what one batch of the scan has for a block, so similar texts are compressed together before
    they are shuffled. ``unpack`` reads the parts of a block.
    """
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), *deal), F.lit(blocks)).cast("int").alias("block"),
                       F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    return rows.mapInArrow(_pack, "block int, part binary")


def _pack(batches):
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        of = batch.column(0).to_numpy()
        order = np.argsort(of, kind="stable")
        rows = batch.select(batch.schema.names[1:])
        edge = np.flatnonzero(np.diff(of[order])) + 1
        blocks, parts = [], []
        for at in np.split(order, edge) if len(order) else []:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows.take(pa.array(at)))
            blocks.append(int(of[at[0]])), parts.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])


def unpack(table: pa.Table) -> pa.Table:
    """The rows of a block from its parts (every block that is asked about has some)."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("part").to_pylist()])


def texts_of(table: pa.Table, name: str = "text") -> list[bytes]:
    return table.column(name).cast(pa.large_binary()).to_pylist()


def by_bucket(table: pa.Table, name: str) -> list[bytes]:
    """The answers to one block, in the order of its buckets."""
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    col = table.column(name).to_pylist()
    return [col[i] for i in order]


def pack_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).astype(bool)


def answers(table: pa.Table | None, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """One flag for each sorted key of a block, from the answers of its buckets."""
    out = np.zeros(len(keys), dtype=bool)
    if table is None or not table.num_rows:
        return out
    b = bounds(keys, buckets)
    kinds, bucket, bits = (table.column(c).to_pylist() for c in ("kind", "bucket", "bits"))
    for k, i, x in zip(kinds, bucket, bits):
        if k == kind:
            out[b[i]:b[i + 1]] = unpack_bits(x, b[i + 1] - b[i])
    return out


def references(table: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    out = np.full(len(keys), -1, dtype=np.int32)
    b = bounds(keys, buckets)
    for k, i, x in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "refs"))):
        if k == 0:
            out[b[i]:b[i + 1]] = np.frombuffer(x, dtype=np.int32)
    return out


SENT = "bucket int, block int, k1 binary, k2 binary, many binary"
TOLD = "kind int, block int, bucket int, bits binary, refs binary"


def send(block: int, k1: np.ndarray, k2: np.ndarray | None, many: np.ndarray, buckets: int) -> pa.Table:
    b = bounds(k1, buckets)
    rows = [(i, block, pack_keys(k1[s:e]), b"" if k2 is None else k2[s:e].tobytes(), pack_bits(many[s:e]))
            for i, (s, e) in enumerate(zip(b[:-1], b[1:])) if e > s]
    cols = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["bucket", "block", "k1", "k2", "many"])


def merge(kind: int):
    """A bucket's answer to each block: which of its keys occur at more than one place, and where first."""
    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        block = table.column("block").to_numpy()
        k1 = [unpack_keys(x) for x in table.column("k1").to_pylist()]
        sizes = np.array([len(x) for x in k1])
        many = np.concatenate([unpack_bits(x, n) for x, n in zip(table.column("many").to_pylist(), sizes)])
        k1 = np.concatenate(k1)
        source = np.repeat(block, sizes).astype(np.int32)
        if kind:
            k2 = np.frombuffer(b"".join(table.column("k2").to_pylist()), dtype=np.uint32)
            order = np.lexsort((k2, k1))
            s1, s2 = k1[order], k2[order]
            new = np.ones(len(s1), dtype=bool)
            new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        else:
            order = np.argsort(k1, kind="stable")
            s1 = k1[order]
            new = np.ones(len(s1), dtype=bool)
            new[1:] = s1[1:] != s1[:-1]
        first = np.flatnonzero(new)
        places = np.add.reduceat(1 + many[order].astype(np.int64), first)
        group = np.empty(len(k1), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        repeated = (places > 1)[group]
        ends = np.cumsum(sizes)
        refs = [b""] * len(sizes)
        if not kind:
            least = np.minimum.reduceat(source[order], first)[group]
            least[~repeated] = -1
            refs = [least[e - n:e].astype(np.int32).tobytes() for n, e in zip(sizes, ends)]
        m = len(sizes)
        return pa.table({"kind": pa.array([kind] * m, pa.int32()), "block": pa.array(block, pa.int32()),
                         "bucket": pa.array([bucket] * m, pa.int32()),
                         "bits": pa.array([pack_bits(repeated[e - n:e]) for n, e in zip(sizes, ends)], pa.binary()),
                         "refs": pa.array(refs, pa.binary())})
    return merge
