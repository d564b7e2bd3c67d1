"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct ``width``-word shingles. Two documents link when
``100 * |intersection| >= percent * |union|``.

1. *Classes.* Equal sets (128-bit fingerprint) are one class, numbered when the table of classes is written; its text is that of
   its least document.
2. *Order.* Shingles are ordered by the number of documents that hold them, then by hash: rare ones first. The counts come from
   a blocked lookup (``blocks.py``) of the first 48 bits of every shingle's hash, so they are as fine at any size of the input. Any order
   gives right results; this one keeps frequent shingles out of the prefixes. A shingle that one document alone holds, links nothing, and
   is counted but not stored.
3. *Grouped prefixes.* A set of n shingles keeps the first ``n - ceil(percent * n / 100) + 1``: linked sets share one of
   them. Classes with the same prefix and size are collapsed into one group, and groups that share a
   prefix shingle are paired if their sizes and the shingle's places leave enough room for the overlap. Of the
   shingles before a shared one, only those that other groups have in their prefix too can be common, so places are
   also counted among these alone.
4. *Hubs first, then the rest.* Groups are first paired only with the hubs of each shingle's list, one to a band of sizes that
   can link: the group with the fewest rarer shingles before this one, of near copies the text that differs least from all
   others. A group meets the hubs of its own band and of the one below, its members meet its least one; the pairs are verified on the texts. Then, per shingle, groups are split by the
   components so far and all pairs of parts from different components are expanded to their members and
   verified; a pair is taken up where its last shared shingle is not the same on both sides, so once and not for every
   shingle. Pairs within the largest component of a list are never formed: they cannot change a component. So a group
   of thousands of near copies costs thousands of pairs, not millions, and no link that matters is lost.

Edge cases: a document with fewer words than ``width`` has its whole sequence as its one shingle; one without words or
text has an empty set, links with nothing and is its own component; repeated rows are each returned, and rows of one id with
different texts are different documents whose links count each for itself; a class that only rows with a null id hold has no
links; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from . import blocks as B
from .components import connected_components
from .member_filter import maybe_among, maybe_repeated, member_filter, repeated_filter

BASE = 0x9E3779B97F4A7C15
SHIFT = B.U(16)                # of a shingle's hash 48 bits are counted
SENT = "bucket int, block int, keys binary, counts binary"
TOLD = "block int, bucket int, levels binary"
PREPARED = "doc long, text_hash long, n long, s1 long, s2 long, p1 long, p2 long, lone int, prefix array<long>"


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of all shingles of a text, repeats included."""
    h = B.hash_words(text.lower().split())
    if not len(h):
        return h
    k = min(width, len(h))
    return B.mix(B.rolling(h, k, BASE) ^ B.U(k))


def need(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any set that it links with."""
    return -(-percent * size // 100)


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _totals(table: pa.Table) -> pa.Table:
    """A key range's answer to each block: for each of its keys a level of document frequency, 0 for one document alone, 8 more for
    each doubling."""
    keys = [B.unpack_keys(x) for x in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    counts = np.concatenate([np.frombuffer(pa.decompress(x, 4 * n, "zstd"), dtype=np.uint32)
                             for x, n in zip(table.column("counts").to_pylist(), sizes)])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
    level = np.empty(len(keys), dtype=np.uint8)
    level[order] = np.minimum(np.log2(total) * 8, 255).astype(np.uint8)[np.cumsum(new) - 1]
    cut = np.cumsum([0, *sizes])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "levels": pa.array([pa.compress(level[s:e].tobytes(), "zstd", asbytes=True) for s, e in zip(cut[:-1], cut[1:])], pa.binary())})


def _prepared(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    n = B.block_count(docs, text_col, block_bytes)
    texts = B.in_blocks(docs, n, id_col, text_col, (F.xxhash64(text_col).alias("text_hash"),), deal=(text_col,))

    def read(t: pa.Table):
        pa.default_memory_pool().release_unused()            # of the block before
        rows = B.unpack(t)
        sets = [np.unique(shingles(x or b"", width)) for x in B.texts_of(rows)]
        keys, counts = np.unique(np.concatenate(sets) >> SHIFT, return_counts=True)
        return rows, sets, keys, counts.astype(np.uint32), B.bounds(keys << SHIFT, n)

    def index(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        _, _, keys, counts, b = read(t)
        rows = [(i, block, B.pack_keys(keys[s:e]), pa.compress(counts[s:e].tobytes(), "zstd", asbytes=True))
                for i, (s, e) in enumerate(zip(b[:-1], b[1:])) if e > s]
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["bucket", "block", "keys", "counts"])

    def prefixes(t: pa.Table, told: pa.Table) -> pa.Table:
        rows, sets, keys, _, b = read(t)
        level = np.zeros(len(keys), dtype=np.uint8)
        for i, x in zip(told.column("bucket").to_pylist(), told.column("levels").to_pylist()):
            level[b[i]:b[i + 1]] = np.frombuffer(pa.decompress(x, int(b[i + 1] - b[i]), "zstd"), dtype=np.uint8)
        out = []
        for h in sets:
            p = len(h) - need(len(h), percent) + 1 if len(h) else 0
            rank = level[np.searchsorted(keys, h >> SHIFT)]
            order = np.lexsort((h, rank))[:p]
            lone = int(np.count_nonzero(rank[order] == 0))
            out.append((len(h), *fingerprint(h), *fingerprint(h[order]), lone, h[order[lone:]].view(np.int64)))
        kinds = (pa.int64(),) * 5 + (pa.int32(), pa.list_(pa.int64()))
        cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.table([rows.column("doc"), rows.column("text_hash"), *cols],
                        names=["doc", "text_hash", "n", "s1", "s2", "p1", "p2", "lone", "prefix"])

    sent = texts.groupBy("block").applyInArrow(index, SENT)
    told = sent.groupBy("bucket").applyInArrow(_totals, TOLD)
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(prefixes, PREPARED)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct pairs (a, b) of classes whose texts link."""
    pairs = cut_lineage(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    asked = cut_lineage(asked.join(classes.select("cls", F.col("class_id").alias("doc"), "text_hash"), "cls"), "asked")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    texts = maybe_among(texts, "doc", member_filter(asked.select("doc")))
    texts = cut_lineage(texts.join(asked.hint("merge"), ["doc", "text_hash"]).select("cls", "text").dropDuplicates(["cls"]), "pair-texts")
    both = (pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
            .join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")).hint("merge"), "a"))

    def linked(batches):
        last = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), *(batch.column(i).cast(pa.large_binary()).to_pylist() for i in (2, 3))):
                if last[0] != a:
                    last = a, np.unique(shingles(ta, width))
                x, y = last[1], np.unique(shingles(tb, width))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(linked, "a long, b long")


def _postings(groups: DataFrame, shared) -> DataFrame:
    """(gid, n, at, token) of every prefix shingle that may be in another prefix too."""
    def explode(batches):
        for b in batches:
            prefix = b.column("prefix")
            token, size = prefix.flatten().to_numpy(), prefix.value_lengths().to_numpy()
            at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size - b.column("lone").to_numpy(), size)
            keep = maybe_repeated(token, shared.value)
            row = np.repeat(np.arange(len(size)), size)[keep]
            yield pa.record_batch([b.column("gid").take(pa.array(row)), b.column("n").take(pa.array(row)),
                                   pa.array(at[keep].astype(np.int32)), pa.array(token[keep])], names=["gid", "n", "at", "token"])

    return groups.select("gid", "n", "lone", "prefix").mapInArrow(explode, "gid long, n long, at int, token long")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id",
                       text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``class_id`` (least document with the same set),
    ``component_id`` (least document reachable by links, itself included), ``component`` (a number of the component, null for an empty
    set) and ``text_hash`` (``xxhash64`` of the text, which tells rows of one id apart)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prepared = cut_lineage(_prepared(own, width, percent, "doc_id", "text", block_bytes), "prefixes")
    # numbered once, as the table is written; all else reads that table
    classes = cut_lineage(prepared.filter("n > 0").groupBy("s1", "s2").agg(
        F.min("doc").alias("class_id"), F.min_by("text_hash", "doc").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "p1", "p2", "lone", "prefix")])
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = classes.select("cls", "n", "p1", "p2")
    groups = cut_lineage(classes.groupBy("n", "p1", "p2").agg(F.min("cls").alias("gid"), F.first("lone").alias("lone"),
                                                              F.first("prefix").alias("prefix")), "groups")
    in_group = cut_lineage(members.join(groups.select("gid", "n", "p1", "p2"), ["n", "p1", "p2"]).select("gid", "cls"), "members")

    postings = _postings(groups, repeated_filter(groups.select("prefix")))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    by_group = Window.partitionBy("gid").orderBy("at")                 # at most one prefix a group
    lists = cut_lineage(postings.join(shared.select("token"), "token")
                        .withColumn("among", F.row_number().over(by_group) - 1)
                        .withColumn("prev", F.lag("token").over(by_group)), "lists")

    def room(x: str, y: str):
        """Sizes and places of a shared shingle leave room for the overlap that a link needs."""
        n1, n2 = F.col(f"{x}.n"), F.col(f"{y}.n")
        after = F.least(n1 - F.col(f"{x}.at") - 1, n2 - F.col(f"{y}.at") - 1)
        most = F.least(F.col(f"{x}.among"), F.col(f"{y}.among")) + 1 + after
        return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
                & ((100 + percent) * most >= percent * (n1 + n2)))

    # sizes of one band are within the ratio that links allow, so linked sizes are in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(min(percent, 99) / 100)).cast("int")
    hubs = lists.groupBy("token", band.alias("band")).agg(F.min_by(F.struct("gid", "n", "at", "among"), F.struct("at", "gid")).alias("hub"))
    hubs = hubs.select("token", F.col("hub.*"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    star = (lists.withColumn("band", band).alias("x").join(hubs.alias("y"), ["token", "band"])
            .filter((F.col("x.gid") != F.col("y.gid")) & room("x", "y"))
            .select(F.col("x.gid").alias("gid"), F.col("y.gid").alias("a")).distinct())
    pairs = (star.join(in_group, "gid").select("a", F.col("cls").alias("b"))
             .unionByName(in_group.select(F.col("gid").alias("a"), F.col("cls").alias("b"))))
    links = cut_lineage(verify(pairs, classes, own, width, percent, "doc_id", "text"), "links")
    # groundwork for the second round: the components so far
    roots = connected_components(links)

    parts = cut_lineage(in_group.join(roots, F.col("cls") == F.col("node"), "left")
                        .select("gid", "cls", F.coalesce("root", "cls").alias("comp")), "parts")
    # per shingle: parts of groups by component; the component with most parts is only paired with the others
    split = lists.join(parts.select("gid", "comp").distinct(), "gid")
    held = split.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = held.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    split = cut_lineage(split.join(most.select("token", (F.col("most.comp")).alias("most")), "token"), "open-lists")
    few = split.filter("comp <> most")
    # a pair whose last shared shingles are the same has been met there
    fresh = (F.col("x.token") == F.col("y.token")) & ~(F.col("x.prev") == F.col("y.prev")).eqNullSafe(True) & room("x", "y")
    pair = [F.col("x.gid").alias("g1"), F.col("x.comp").alias("c1"), F.col("y.gid").alias("g2"), F.col("y.comp").alias("c2")]
    across = (few.alias("x").join(few.alias("y"), fresh & (F.col("x.comp") < F.col("y.comp"))).select(pair)
              .unionByName(split.filter("comp = most").alias("x").join(few.alias("y"), fresh).select(pair)).distinct())
    within = (in_group.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").join(parts, "gid")
              .select("gid", "comp").distinct())
    inside = (within.alias("x").join(within.alias("y"), (F.col("x.gid") == F.col("y.gid")) & (F.col("x.comp") < F.col("y.comp")))
              .select(F.col("x.gid").alias("g1"), F.col("x.comp").alias("c1"), F.col("y.gid").alias("g2"),
                      F.col("y.comp").alias("c2")))
    one = parts.select(F.col("gid").alias("g1"), F.col("comp").alias("c1"), F.col("cls").alias("a"))
    two = parts.select(F.col("gid").alias("g2"), F.col("comp").alias("c2"), F.col("cls").alias("b"))
    rest = across.unionByName(inside).distinct().join(one, ["g1", "c1"]).join(two, ["g2", "c2"]).select("a", "b")
    more = cut_lineage(verify(rest, classes, own, width, percent, "doc_id", "text"), "links")
    roots = connected_components(roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))

    named = classes.join(roots, F.col("cls") == F.col("node"), "left").select(
        "s1", "s2", "class_id", F.coalesce("root", "cls").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("class_id").alias("component_id")), "component")
    return prepared.join(named, ["s1", "s2"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("component_id", "doc").alias("component_id"), "component", "text_hash")
