"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches. A *run* is a table of line hashes in the shared checkpoint folder, range
partitioned and sorted by hash, with how many documents held the line so far and the largest id among them.
A new batch is merge-joined with the runs: what finds no match is new, what does is carried on, and
the batch adds its own run with the figures so far. When a level holds ``fanout`` runs they are
compacted into one run of the next level, so a batch meets a logarithmic number of runs. A later run supersedes
an earlier one, which a key's largest count tells without an order.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the
document with the largest id that holds them. Keys are told apart by 128-bit hashes.

The last join shuffles the texts by id at every size (a merge join, not a broadcast that a larger input would not get).

Hot lines: the distinct (line, document) step shuffles by both, the count is combined before its shuffle, and
the join back of a line that a third of the documents hold is an ordinary equi-join that adaptive execution splits.

Edge cases: a null or empty text is one empty line; rows with the same id are one document when
documents are counted, and each of them is cut; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    return line.strip().lower()             # bytes: white space and letters of ASCII alone


def _hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def line_hashes(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h1, h2): the distinct keys of each row that are long enough."""
    def hashes(batches):
        for b in batches:
            ids, one, two = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                keys = {line_key(x) for x in (text or b"").split(b"\n") if len(x) >= min_chars}
                for k in keys:
                    if _long_enough(k, min_chars):
                        x, y = _hash(k)
                        ids.append(doc), one.append(x), two.append(y)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                                  names=["doc", "h1", "h2"])
    return (docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
            .mapInArrow(hashes, "doc long, h1 long, h2 long"))


class LineRuns:
    """Levels of sorted runs; each run is (h1, h2, n_docs, last_doc) with the figures up to its batch."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.root = os.path.join(ensure_checkpoint_dir(spark), "tables", f"runs-{uuid.uuid4().hex}")
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = os.path.join(self.root, f"level={level}", uuid.uuid4().hex)
        df.repartitionByRange("h1").sortWithinPartitions(*KEY).write.parquet(path)
        self.levels[level].append(path)

    def seen(self) -> DataFrame | None:
        """Figures so far of every key in the runs."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return None
        runs = self.spark.read.parquet(*paths)
        return runs if len(paths) == 1 else runs.groupBy(*KEY).agg(
            F.max("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, batch: DataFrame) -> None:
        """Merge-join a batch of (doc, h1, h2) with the runs, add its own run, compact full levels."""
        own = (batch.select("doc", *KEY).distinct()
               .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc")))
        seen = self.seen()
        if seen is not None:
            old = seen.withColumnsRenamed({"n_docs": "old_n", "last_doc": "old_doc"})
            own = own.join(old, KEY, "left").select(
                *KEY, (F.col("n_docs") + F.coalesce("old_n", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "old_doc").alias("last_doc"))
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.spark.read.parquet(*self.levels[level]).groupBy(*KEY).agg(
                F.max("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            self.levels[level] = []
            level += 1
            self._write(full, level)

    def new_lines(self, batch: DataFrame) -> DataFrame:
        """The part of a batch that no run holds (merge anti join)."""
        seen = self.seen()
        return batch if seen is None else batch.join(seen.select(*KEY), KEY, "left_anti")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped`` added.

    ``batches``: rounds in which the documents are taken up (by a hash of their id), as they would come in.
    """
    spark = docs.sparkSession
    staged = cut_lineage(line_hashes(docs, min_chars, id_col, text_col)
                         .withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches))), "lines")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(staged.filter(F.col("batch") == b))
    common = cut_lineage(runs.seen().filter(F.col("n_docs") >= min_docs), "common-lines")
    cut = (staged.join(common, KEY).filter(~F.col("doc").eqNullSafe(F.col("last_doc")))
           .groupBy("doc").agg(F.collect_list(F.struct(*KEY)).alias("cut")))
    cut = cut_lineage(cut.select(F.col("doc").alias("__doc"), "cut"), "cut-lines")

    own = docs.columns
    joined = docs.join(cut.hint("merge"), F.col(id_col) == F.col("__doc"), "left").select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(text_col).alias("text"), "cut")

    def apply(found):
        for b in found:
            kept, lines, dropped = [], [], []
            for text, cut in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist()):
                all_lines = (text or b"").split(b"\n")
                stay = all_lines
                if cut:
                    gone = {(c["h1"], c["h2"]) for c in cut}
                    stay = [x for x in all_lines if len(x) < min_chars or _hash(line_key(x)) not in gone]
                kept.append(b"\n".join(stay)), lines.append(len(all_lines)), dropped.append(len(all_lines) - len(stay))
            yield pa.record_batch([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()),
                                   pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                  names=["row", "kept_text", "n_lines", "n_dropped"])

    schema = f"row {joined.schema['row'].dataType.simpleString()}, kept_text string, n_lines long, n_dropped long"
    return joined.mapInArrow(apply, schema).select("row.*", "kept_text", "n_lines", "n_dropped")
