"""Byte-pair encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last ``WINDOW`` bytes has its low bits zero, so passages that documents share
are cut alike. Chunk keys are counted over all documents (``blocks``); a chunk found more than once is encoded by one
block alone, the first that holds it, and its ids go to the other blocks that ask for it. Everything else is
encoded where it stands.

Chunk joins are repaired by re-encoding: of a shared chunk only the part between its first and last *safe* places
is kept, places where a blank follows a non-blank. The tokenizer's pattern always ends a piece there and looks no
further back, so encodings on both sides do not depend on each other; the owner checks that its token
boundaries agree with both places and else gives the chunk up. The text between two kept parts, over the join, is
encoded anew. So the ids are exactly those of encoding the whole text.

The vocabulary file is read by every worker from ``path`` (a parameter, never copied). Ids come from a rank table
built from its vocabulary; added tokens are cut out of the text first, as the file says.

Edge cases: a null or empty text has no ids; a text without blanks is encoded whole; a chunk without safe
places is encoded with its neighbours; repeated rows are each returned; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import blocks as B

WINDOW = 16
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LONG_RUN = 100_000
LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
ASKED = "bucket int, block int, k1 binary, k2 binary, many binary"
GIVEN = "bucket int, k1 binary, sizes binary, ids binary"
ANSWER = "block int, k1 binary, sizes binary, ids binary"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """A byte-level BPE file: encode bytes of text to ids, and ids back to bytes."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        # byte-level files write byte b as the character b, or as 256, 257, ... in turn where b is not printable
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        self.added = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        own = {t: i for t, i in vocab.items() if t.encode() not in self.added}
        ranks = {bytes(byte[c] for c in t): i for t, i in own.items()}
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if [vocab[t] for t in joined] != sorted(vocab[t] for t in joined):
            raise ValueError("the file's merges are not in the order of their ids")
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.library = path, None
        self.bytes = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for b, i in [*ranks.items(), *self.added.items()]:
            self.bytes[i] = b
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.added)) + b")") if self.added else None

    def encode(self, text: bytes) -> np.ndarray:
        if self.cut is None or not any(x in text for x in self.added):
            return self._plain(text.decode())
        parts = [np.array([self.added[x]], dtype=np.uint32) if x in self.added else self._plain(x.decode())
                 for x in self.cut.split(text) if x]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and LONG_BLANK.search(text):      # the rank table's pattern search recurses on these
            from tokenizers import Tokenizer
            self.library = self.library or Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


class Chunked:
    """The documents of a block as one run of bytes, its chunks and their keys."""

    def __init__(self, table: pa.Table, mask: int):
        self.docs = table.column("doc").to_pylist()
        texts = B.texts_of(table)
        self.data = b"".join(texts)
        n = np.array([len(t) for t in texts], dtype=np.int64)
        self.doc_end = np.cumsum(n)
        self.doc_begin = self.doc_end - n
        raw = np.frombuffer(self.data, dtype=np.uint8)
        rolled = B.rolling(raw.astype(np.uint64) + B.U(1), WINDOW, BASE)
        at = np.flatnonzero((rolled >> B.U(40)) & B.U(mask) == 0) + WINDOW      # high bits: they depend on all bytes
        at = at[at < len(raw)]
        at = at[(raw[at] & 0xC0) != 0x80]                                      # between characters only
        if len(at):                        # by the document's own bytes only, whatever stands next to it in the block
            at = at[at - WINDOW >= self.doc_begin[np.searchsorted(self.doc_end, at - 1, side="right")]]
        edges = np.unique(np.concatenate(([0], at, self.doc_begin, self.doc_end)))
        edges = edges[edges <= len(raw)]
        self.begin, self.end = edges[:-1], edges[1:]
        keys = np.fromiter((xxhash.xxh3_64_intdigest(self.data[s:e]) for s, e in zip(self.begin.tolist(), self.end.tolist())),
                           dtype=np.uint64, count=len(self.begin))
        keys = B.mix(keys)
        self.keys, self.first, self.which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        self.many = counts > 1
        self.raw = raw

    def core(self, s: int, e: int) -> tuple[int, int]:
        """First and last safe place inside [s, e); equal if there are not two."""
        blank = BLANK[self.raw[s:e]]
        safe = np.flatnonzero(blank[1:] & ~blank[:-1] & (self.raw[s:e - 1] < 0x80)) + 1
        return (s + int(safe[0]), s + int(safe[-1])) if len(safe) > 1 else (s, s)


def _core_ids(c: Chunked, tool: Codec, s: int, e: int) -> np.ndarray:
    """Ids of a chunk's core, cut from those of the whole chunk where the token boundaries agree."""
    p, q = c.core(s, e)
    if p == q:
        return np.empty(0, dtype=np.uint32)
    ids = tool.encode(c.data[s:e])
    edge = np.concatenate(([0], np.cumsum(tool.length[ids]))) + s
    i, j = np.searchsorted(edge, (p, q))
    return ids[i:j] if edge[i] == p and edge[j] == q else np.empty(0, dtype=np.uint32)


def _blobs(keys: np.ndarray, ids: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    sizes = np.array([len(x) for x in ids], dtype=np.uint32)
    flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32)
    narrow = np.uint16 if not len(flat) or flat.max() < 2**16 else np.uint32
    return B.pack_keys(keys), sizes.tobytes(), flat.astype(narrow).tobytes()


def _split(sizes: bytes, ids: bytes) -> list[np.ndarray]:
    n = np.frombuffer(sizes, dtype=np.uint32).astype(np.int64)
    flat = np.frombuffer(ids, dtype=np.uint16 if len(ids) == 2 * n.sum() else np.uint32)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def encode(docs: DataFrame, path: str | None = None, chunk_bytes: int = 1024, id_col: str = "doc_id",
           text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the ``decoded`` text.

    ``chunk_bytes``: mean length of a chunk, a power of two.
    """
    path, mask = path or default_path(), chunk_bytes - 1
    n = B.block_count(docs, text_col, block_bytes)
    texts = B.in_blocks(docs, n, id_col, text_col)

    def ask(t: pa.Table) -> pa.Table:
        c = Chunked(B.unpack(t), mask)
        return B.send(t.column("block")[0].as_py(), c.keys, None, c.many, n)

    def own(t: pa.Table, told: pa.Table) -> pa.Table:
        """Ids of the repeated chunks that this block holds first, for each bucket."""
        c, tool, rows = Chunked(B.unpack(t), mask), codec(path), []
        mine = np.flatnonzero(B.references(told, c.keys, n) == t.column("block")[0].as_py())
        cut = B.bounds(c.keys[mine], n)
        for b, (s, e) in enumerate(zip(cut[:-1], cut[1:])):
            if e > s:
                at = c.first[mine[s:e]]
                ids = [_core_ids(c, tool, int(c.begin[i]), int(c.end[i])) for i in at]
                rows.append((b, *_blobs(c.keys[mine[s:e]], ids)))
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["bucket", "k1", "sizes", "ids"])

    def deal(asked: pa.Table, given: pa.Table) -> pa.Table:
        """Every block's asked chunks of this key range with their ids."""
        keys, ids, rows = [], [], []
        for k, s, x in zip(*(given.column(i).to_pylist() for i in ("k1", "sizes", "ids"))):
            keys.append(B.unpack_keys(k))
            ids += _split(s, x)
        if keys:
            keys = np.concatenate(keys)
            order = np.argsort(keys)
            keys = keys[order]
            for block, k in zip(asked.column("block").to_pylist(), asked.column("k1").to_pylist()):
                k = B.unpack_keys(k)
                at = np.searchsorted(keys, k)
                hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == k)
                if hit.any():
                    rows.append((block, *_blobs(k[hit], [ids[order[i]] for i in at[hit]])))
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["block", "k1", "sizes", "ids"])

    def finish(t: pa.Table, answer: pa.Table) -> pa.Table:
        c, tool = Chunked(B.unpack(t), mask), codec(path)
        known = [None] * len(c.keys)
        for k, s, x in zip(*(answer.column(i).to_pylist() for i in ("k1", "sizes", "ids"))):
            for i, ids in zip(np.searchsorted(c.keys, B.unpack_keys(k)).tolist(), _split(s, x)):
                known[i] = ids
        sizes, out, decoded = [], [], []
        lo = np.searchsorted(c.begin, c.doc_begin)
        hi = np.searchsorted(c.begin, c.doc_end)
        for d, (b, e) in enumerate(zip(c.doc_begin.tolist(), c.doc_end.tolist())):
            parts, at = [], b
            for i in range(lo[d], hi[d]):
                ids = known[c.which[i]]
                if ids is not None and len(ids):
                    p, q = c.core(int(c.begin[i]), int(c.end[i]))
                    if p > at:
                        parts.append(tool.encode(c.data[at:p]))          # over the join, anew
                    parts.append(ids)
                    at = q
            if e > at:
                parts.append(tool.encode(c.data[at:e]))
            ids = np.concatenate(parts).astype(np.uint32) if parts else np.empty(0, dtype=np.uint32)
            sizes.append(len(ids)), out.append(ids.astype("<u4").tobytes())
            decoded.append(tool.decode(ids).decode("utf-8", "replace"))
        return pa.table({"doc_id": pa.array(c.docs, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                         "ids": pa.array(out, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    asked = texts.groupBy("block").applyInArrow(ask, ASKED)
    told = asked.groupBy("bucket").applyInArrow(B.merge(0), B.TOLD)
    given = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(own, GIVEN)
    answer = asked.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(deal, ANSWER)
    return texts.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(finish, ENCODED)
