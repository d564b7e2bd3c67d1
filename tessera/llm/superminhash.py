"""MinHash near-duplicates with SuperMinHash signatures.

A document's set is its distinct ``width``-word shingles. Two documents link when ``100 * |intersection| >= percent * |union|``.

1. *Classes.* Equal sets (128-bit fingerprint) are one class.
2. *SuperMinHash.* Each shingle deals the numbers 0, 1, 2, ... plus a fraction to the places of the signature in an order of its
   own; a place keeps its least value. As every shingle fills each place once, the places are negatively correlated and estimates
   of similarity vary less than with independent hashes. A set stops at step j once no place holds more than j: long sets
   after one or two steps. A place is kept as one byte of a hash of its value.
3. *Banding.* ``BANDS`` bands of ``ROWS`` places; classes that agree in a band share its bucket. At a similarity of 0.8 all
   bands miss a pair with a probability of 3 in a million, at 0.3 one of thirty pairs meets.
4. *Verification.* Pairs are first held against their signatures (a pair at the threshold passes but for one in 10**9), then against
   the full sets of both texts. Every class is paired with the leaders of its buckets: in each the class that lies in most and
   largest buckets, so the text that a group of copies goes back to. Buckets that still hold several groups are then searched
   whole: members of the smaller groups are compared with all members of other groups, ``TILE`` by ``TILE``, by ``MORE`` further
   signatures, ``LONG`` places in all (a link passes but for one pair in three million), and what passes is verified too. Members of a bucket's largest
   group are never compared with each other, so a group of thousands of copies costs thousands of pairs. No round has a cap.
5. *Union-find grouping.* Each task links its pairs in a union-find forest and hands on the forest alone; the forests meet in
   alternating star contractions (``components``).

Edge cases: a document with fewer words than ``width`` has its whole sequence as its one shingle; one without words or text has
an empty set, links with nothing and is its own component; a null id takes part, but names no component unless there is no other (then
null); rows that repeat an id are told apart by their texts, and each is returned; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B
from .components import connected_components
from .member_filter import maybe_among, member_filter

ROWS, BANDS = 6, 42
PLACES = ROWS * BANDS
#: Places of the signatures that tell apart the members of a bucket with several groups; the first PLACES are the others'.
MORE = 3
LONG = PLACES + MORE * 256
TILE = 1024
BASE = 0x9E3779B97F4A7C15
#: Shingles worked on at a time (fewer for longer signatures): the orders that they have dealt so far take a byte or more a place.
AT_ONCE = 1 << 17


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    h = B.hash_words(text.lower().split())                  # bytes: white space and letters of ASCII alone
    if not len(h):
        return h
    k = min(width, len(h))
    return np.unique(B.mix(B.rolling(h, k, BASE) ^ B.U(k)))


def _draw(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th random number of every shingle."""
    return B.mix(h + B.U((j + 1) * 0xD1B54A32D192ED03 % 2**64))


def superminhash(sets: list[np.ndarray], places: int = PLACES, seed: int = 0) -> np.ndarray:
    """One row of ``places`` values for each non-empty set: the value of a place is its step and 32 random bits."""
    empty = np.iinfo(np.int64).max
    out = np.full((len(sets), places), empty, dtype=np.int64)
    flat = out.ravel()
    elements = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    if seed:
        elements = B.mix(elements + B.U(seed))
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    going, order = np.ones(len(sets), dtype=bool), None     # order: who has dealt what, only from the second step on
    for j in range(places):
        r = _draw(elements, j)
        # a place among those not dealt yet: the low half picks it, the high half is the fraction
        k = j + (((r & B.U(0xFFFFFFFF)) * B.U(places - j)) >> B.U(32)).astype(np.int64)
        i = np.arange(len(elements))
        place = k if order is None else order[i, k].astype(np.int64)
        if order is not None:
            order[i, k], order[i, j] = order[i, j], place
        np.minimum.at(flat, of * places + place, (np.int64(j) << 32) | (r >> B.U(32)).astype(np.int64))
        live = np.flatnonzero(going)
        going[live] = (out[live] == empty).any(axis=1)      # a place that holds a value holds one of this step or an earlier one
        stay = going[of]
        if not stay.any():
            break
        if order is None:
            elements, of, k = elements[stay], of[stay], k[stay]
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(elements), 1))
            i = np.arange(len(elements))
            order[i, k] = 0
            order[i, 0] = k
        elif not stay.all():
            elements, of, order = elements[stay], of[stay], order[stay]
    return out


def signature_bytes(sets: list[np.ndarray], places: int = PLACES, seed: int = 0) -> list[bytes]:
    """Signatures with one byte a place, in pieces of at most ``AT_ONCE`` bytes a place or one set."""
    out, piece, held = [], [], 0
    for s in [*sets, None]:
        if piece and (s is None or (held + len(s)) * places > AT_ONCE * PLACES):
            short = (B.mix(superminhash(piece, places, seed).view(np.uint64)) >> B.U(56)).astype(np.uint8)
            out += [x.tobytes() for x in short]
            piece, held = [], 0
        if s is not None:
            piece.append(s)
            held += len(s)
    return out


def least_agreement(percent: int, places: int = PLACES, deviations: float = 6.0) -> int:
    """Agreeing places below which a pair of at least this similarity is all but impossible."""
    t = percent / 100
    return max(0, math.floor(places * t - deviations * math.sqrt(places * t * (1 - t))))


def _prepared(docs: DataFrame, width: int) -> DataFrame:
    """(doc, mark, n, s1, s2, sig): ``mark`` tells texts of one id apart."""
    def rows(batches):
        for b in batches:
            sets = [shingle_set(t or b"", width) for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = [None] * len(sets)
            for i, x in zip(full, signature_bytes([sets[i] for i in full])):
                sig[i] = x
            half = lambda a, z: pa.array([int.from_bytes(p[a:z], "big", signed=True) for p in prints], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), half(0, 8), half(8, 16),
                                   pa.array(sig, pa.binary())], names=["doc", "mark", "n", "s1", "s2", "sig"])

    return docs.select("doc", "mark", "text").mapInArrow(rows, "doc long, mark long, n long, s1 long, s2 long, sig binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, node): a class is in one bucket a band. The key holds the band and its ROWS bytes whole."""
    def rows(batches):
        for b in batches:
            sig = b.column(1).to_pylist()
            if not sig:
                continue
            x = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(sig), BANDS, ROWS).astype(np.int64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.int64), (len(sig), BANDS)).copy()
            for i in range(ROWS):
                key = (key << 8) | x[:, :, i]
            yield pa.record_batch([pa.array(key.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))],
                                  names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(rows, "key long, node long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose signatures agree in enough places."""
    least = least_agreement(percent)
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(
        F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))

    def agree(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, PLACES) for i in (2, 3))
            keep = (x == y).sum(axis=1) >= least if b.num_rows else np.empty(0, dtype=bool)
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def texts_of(asked: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): one text of each class in ``asked``."""
    where = classes.join(asked, "node", "left_semi").select("node", F.col("rep.doc").alias("doc"), F.col("rep.mark").alias("mark"))
    row = F.xxhash64("doc", "mark").alias("__row")
    some = maybe_among(docs.select("*", row), "__row", member_filter(where.select(row)))
    x, y = where.alias("x"), some.alias("y")
    return y.join(x.hint("merge"), F.col("x.doc").eqNullSafe(F.col("y.doc")) & (F.col("x.mark") == F.col("y.mark"))).select(
        "node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets link, as a forest of each task (union-find)."""
    pairs = cut_lineage(pairs, "likely")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = cut_lineage(texts_of(cut_lineage(asked, "asked"), classes, docs), "texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")).hint("merge")

    def linked(batches):
        last, forest = (None, None), {}

        def find(i):
            while forest.setdefault(i, i) != i:
                forest[i] = forest[forest[i]]
                i = forest[i]
            return i
        for batch in batches:
            a_out, b_out = [], []
            for a, c, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    *(batch.column(i).cast(pa.large_binary()).to_pylist() for i in (2, 3))):
                if last[0] != a:
                    last = a, shingle_set(ta, width)
                x = last[1]
                ra, rc = find(a), find(c)
                if ra == rc:
                    continue
                y = shingle_set(tb, width)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    forest[max(ra, rc)] = min(ra, rc)
                    a_out.append(a), b_out.append(c)
            if len(forest) > B.CACHE_WORDS:                 # start afresh: links may then repeat, none is lost
                forest.clear()
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(linked, "a long, b long")


def long_signatures(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, long): signatures of ``LONG`` places of the classes in ``nodes``."""
    def rows(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            more = [signature_bytes(sets, 256, seed) for seed in range(1, MORE + 1)]
            yield pa.record_batch([b.column(0), pa.array(map(b"".join, zip(b.column(1).to_pylist(), *more)), pa.binary())],
                                  names=["node", "long"])

    texts = texts_of(nodes, classes, docs)
    return texts.join(classes.select("node", "sig"), "node").select("node", "sig", "text").mapInArrow(rows, "node long, long binary")


def across_groups(still: DataFrame, long: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of different groups in the buckets ``still`` (key, node, g, most): the members outside of a bucket's largest group with all
    of its members, in tiles of at most about ``TILE`` by ``TILE``. A pair is given once, in the first band that it shares."""
    least = least_agreement(percent, LONG, 5.0)
    rows = (still.join(long, "node").join(classes.select("node", "n"), "node")
            .select("key", "node", "g", "n", "long", (F.col("g") != F.col("most")).alias("few")))
    parts = rows.groupBy("key").agg(F.ceil(F.sum(F.col("few").cast("int")) / TILE).cast("int").alias("f_parts"),
                                    F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("a_parts"))
    rows = rows.join(parts, "key")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("key", "i", "j", "left", "few", "node", "g", "n", "long")
    tiles = (rows.filter("few").withColumns({"left": F.lit(True), "i": deal("f_parts")}).withColumn("j", every("a_parts")).select(*cols)
             .unionByName(rows.withColumns({"left": F.lit(False), "j": deal("a_parts")}).withColumn("i", every("f_parts")).select(*cols)))

    def compare(table):
        key = table.column("key")[0].as_py()
        left = table.column("left").to_numpy()
        node, g, n = (table.column(c).to_numpy() for c in ("node", "g", "n"))
        sig = np.frombuffer(b"".join(table.column("long").to_pylist()), dtype=np.uint8).reshape(-1, LONG)
        ours, theirs = np.flatnonzero(left), np.flatnonzero(~left)
        few = table.column("few").to_numpy()[theirs]         # these meet once from each side
        out = []
        for x in ours:
            y = theirs[(g[theirs] != g[x]) & (~few | (node[theirs] > node[x]))
                       & (100 * np.minimum(n[theirs], n[x]) >= percent * np.maximum(n[theirs], n[x]))]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= least]
            same = (sig[y, :PLACES] == sig[x, :PLACES]).reshape(-1, BANDS, ROWS).all(axis=2)
            y = y[same.argmax(axis=1) == key >> 8 * ROWS]
            out += [(min(node[x], v), max(node[x], v)) for v in node[y]]
        return out

    def run(batches):
        held, at = [], None

        def done():
            pairs = compare(pa.Table.from_batches(held)) if held else []
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)] if len(ids) else []
            for s, e in zip(edges[:-1], edges[1:]):
                if at != tuple(ids[s]):
                    yield done()
                    held, at = [], tuple(ids[s])
                held.append(batch.slice(s, e - s))
        yield done()

    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable by links, itself included) and ``kept``
    (its own id names the component)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    prepared = cut_lineage(_prepared(own, width), "signatures")
    classes = cut_lineage(prepared.filter("n > 0").groupBy("s1", "s2").agg(
        F.min("doc").alias("least"), F.min(F.struct("doc", "mark")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")

    rows = _buckets(classes)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = cut_lineage(rows.join(sizes, "key"), "buckets")
    weight = shared.groupBy("node").agg(F.sum("c").alias("w"))           # a text that many resemble is in large buckets
    leaders = shared.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("leader"))
    votes = shared.join(leaders, "key").filter("node <> leader").select("node", "leader").distinct()
    pairs = votes.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    links = cut_lineage(verified(likely(pairs, classes, percent), classes, own, width, percent), "links")
    groups = cut_lineage(connected_components(links), "groups")

    def with_group(df: DataFrame, groups: DataFrame, col: str, name: str) -> DataFrame:
        named = groups.select(F.col("node").alias(col), F.col("root").alias("__root"))
        return df.join(named, col, "left").withColumn(name, F.coalesce("__root", col)).drop("__root")

    placed = with_group(shared.select("key", "node"), groups, "node", "g")
    held = placed.groupBy("key", "g").agg(F.count(F.lit(1)).alias("c"))
    largest = held.groupBy("key").agg(F.max(F.struct("c", "g")).alias("m"), F.count(F.lit(1)).alias("gs")).filter("gs > 1")
    still = cut_lineage(placed.join(largest.select("key", F.col("m.g").alias("most")), "key"), "open-buckets")
    asked = cut_lineage(still.select("node").distinct(), "asked")
    long = cut_lineage(long_signatures(asked, classes, own, width), "long-signatures")
    more = cut_lineage(verified(across_groups(still, long, classes, percent), classes, own, width, percent), "links")
    between = with_group(with_group(more, groups, "a", "ga"), groups, "b", "gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    tops = cut_lineage(connected_components(between), "groups").select(F.col("node").alias("root"), F.col("root").alias("top"))
    groups = groups.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(
        tops.select(F.col("root").alias("node"), F.col("top").alias("root")))

    named = with_group(classes.select("s1", "s2", "node", "least"), groups, "node", "g")
    least = named.groupBy("g").agg(F.min("least").alias("component_id"))
    named = named.join(least, "g").select("s1", "s2", "component_id")
    out = prepared.join(named, ["s1", "s2"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
