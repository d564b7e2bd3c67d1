"""Text features on a long (doc_id, term, value) table.

The document-term matrix is never materialised as a matrix: term counts come from ``explode`` +
``groupBy(doc, term)``, document frequencies from ``groupBy(term)`` (map-side partial aggregation absorbs
hot terms), and per-document norms from an aggregate joined back on the document key. Vocabulary-sized
tables are joined normally; adaptive execution broadcasts them only when their measured size is below
``spark.sql.autoBroadcastJoinThreshold``. Only one-row scalars (document count, average length) are
cross-joined.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import dense_index

#: Entries of a batch that a counting task sends on.
ENTRIES = 200_000


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
                     term_col: str = "term") -> DataFrame:
    """(doc_id, term, tf): raw count of each term in each document (bag of words, FEA-08)."""
    # explode_outer + a null filter: an inner explode makes the optimizer infer ``size(tokens) > 0`` below
    # the generator, which would evaluate the whole token expression (regexes, n-grams) a second time.
    return (docs.select(id_col, F.explode_outer(tokens_col).alias(term_col)).filter(F.col(term_col).isNotNull())
            .groupBy(id_col, term_col).agg(F.count(F.lit(1)).alias("tf")))


def no_repeats(rows: DataFrame) -> bool:
    """Whether no two rows are the same."""
    return not rows.columns or rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def text_term_counts(docs: DataFrame, text_col: str, stopwords, longer_than: int = 3, keys=("doc_id",),
                     term_col: str = "term", once: bool | None = None) -> DataFrame:
    """(keys..., term, tf) straight from raw text: each row's tokens are folded and counted in Arrow batches, so only its
    distinct terms leave the task. Rows of the same keys are added up; where no two rows share their keys (``once``; None: found out
    from the keys alone) the counts are whole already and nothing is shuffled. Same tokens as ``text.processed_tokens``."""
    import pyarrow as pa

    from ..functions.text import ascii_words
    from .blockmatrix import to_arrow_schema
    keys, stop, least = list(keys), frozenset(stopwords or []), max(longer_than, 0)
    slim = docs.select(*keys, F.col(text_col).cast("binary").alias("_text"))       # bytes: also a text that is no valid UTF-8 is read
    kind = StructType([*[slim.schema[k] for k in keys], StructField(term_col, StringType()), StructField("tf", LongType())])
    schema = to_arrow_schema(kind)

    def rows(batch, at, counts):
        terms = [t for c in counts for t in c]
        n = np.fromiter((x for c in counts for x in c.values()), dtype=np.int64, count=len(terms))
        own = pa.array(np.repeat(np.asarray(at, dtype=np.int64), [len(c) for c in counts]))
        columns = [batch.column(i).take(own).cast(schema.field(i).type) for i in range(len(keys))]
        return pa.record_batch([*columns, pa.array(terms, pa.string()), pa.array(n)], schema=schema)

    def count(batches):
        for b in batches:
            at, counts, size = [], [], 0
            for i, text in enumerate(b.column(len(keys))):
                words = Counter(ascii_words(text.as_py()))
                at.append(i)
                counts.append({w: n for w, n in words.items() if len(w) > least and w not in stop})
                size += len(counts[-1])
                if size > ENTRIES:
                    yield rows(b, at, counts)
                    at, counts, size = [], [], 0
            yield rows(b, at, counts)
    counted = slim.mapInArrow(count, kind)
    if keys and (no_repeats(docs.select(*keys)) if once is None else once):
        return counted
    return counted.groupBy(*keys, term_col).agg(F.sum("tf").alias("tf"))


def document_frequency(tf: DataFrame, term_col: str = "term") -> DataFrame:
    return tf.groupBy(term_col).agg(F.count(F.lit(1)).alias("df"))


def count_documents(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def vocabulary(tf: DataFrame, n_docs: DataFrame, min_df=5, max_df=0.8, max_features: int | None = None,
               term_col: str = "term") -> DataFrame:
    """Terms kept by document-frequency bounds (FEA-01).

    Integer bounds are document counts, float bounds are fractions of the documents (``df <= max_df * n``).
    ``max_features`` keeps the most frequent terms by corpus count, ties by term (FEA-03).
    Returns (term, df, cf, n_docs).
    """
    v = (tf.groupBy(term_col).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
         .crossJoin(n_docs))
    lo = F.lit(min_df) if isinstance(min_df, int) else F.ceil(F.lit(float(min_df)) * F.col("n_docs"))
    hi = F.lit(max_df) if isinstance(max_df, int) else F.lit(float(max_df)) * F.col("n_docs")
    v = v.filter((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features is not None:
        # Exact global top-N by (corpus count desc, term): terms are bucketed by their count, a count
        # table gives each bucket its offset, buckets starting beyond N are dropped, and rows are numbered
        # inside the remaining buckets only -- no single task receives N rows from every partition.
        from ..session import cut_lineage
        v = cut_lineage(v, "vocab")          # the bounded-df vocabulary is read three times below
        v = dense_index(v, term_col, "_top", order=[(F.col("cf"), False), (F.col(term_col), True)],
                        buckets=[(F.col("cf"), False)], max_index=max_features).drop("_top")
    return v


def with_index(vocab: DataFrame, term_col: str = "term") -> DataFrame:
    """Add ``term_index`` (0-based, sorted by term), as the reference's vectorizer numbers its columns."""
    return dense_index(vocab, term_col, "term_index")


# -- TF-IDF (FEA-02 / FEA-04) --------------------------------------------------------------------------------
def smooth_idf(df_col="df", n_col="n_docs"):
    """ln((1 + n) / (1 + df)) + 1, the smoothed idf of the reference's vectorizer."""
    return F.log((F.lit(1.0) + F.col(n_col)) / (F.lit(1.0) + F.col(df_col))) + F.lit(1.0)


def l2_normalise(w: DataFrame, id_col: str = "doc_id", value_col: str = "weight") -> DataFrame:
    """Divide by the document's L2 norm. The norm is a window over the document (one group per
    document, bounded by its distinct terms): one shuffle, and the weights are read once."""
    from pyspark.sql import Window
    nrm = F.sqrt(F.sum(F.col(value_col) * F.col(value_col)).over(Window.partitionBy(id_col)))
    return w.withColumn(value_col, F.when(nrm > 0, F.col(value_col) / nrm).otherwise(F.lit(0.0)))


def fit_tfidf(tf_fit: DataFrame, n_docs: DataFrame, min_df=5, max_df=0.8, max_features=None) -> DataFrame:
    """The fitted model as a table: (term, df, n_docs, idf)."""
    v = vocabulary(tf_fit, n_docs, min_df, max_df, max_features)
    return v.withColumn("idf", smooth_idf()).select("term", "df", "n_docs", "idf")


def apply_tfidf(tf: DataFrame, model: DataFrame, id_col: str = "doc_id", keep=(), model_cols=(), hashed: bool = False) -> DataFrame:
    """(doc_id, [keep...], term, [model_cols...], weight): count x idf, L2 per document. Documents with no vocabulary term
    have no rows. ``keep`` carries document-level columns (e.g. the class) through, ``model_cols`` columns of the model
    (e.g. the term index), so that the entries are joined with it once. ``hashed``: entries are not sorted by term for the join, which takes less time
    and, as rows sorted by term compress better, more bytes in the shuffle by document."""
    model = model.select("term", "idf", *model_cols)
    w = (tf.join(model.hint("shuffle_hash") if hashed else model, "term")
         .select(id_col, *keep, "term", *model_cols, (F.col("tf") * F.col("idf")).alias("weight")))
    return l2_normalise(w, id_col)


def tfidf(docs: DataFrame, id_col="doc_id", tokens_col="tokens", min_df=5, max_df=0.8, max_features=None,
          materialize: bool = False):
    """Fit and transform on one frame (FEA-04). ``materialize`` checkpoints the term-count table, which
    both the fit (vocabulary) and the transform read."""
    tf = term_frequencies(docs, id_col, tokens_col)
    if materialize:
        from ..session import cut_lineage
        tf = cut_lineage(tf)
    model = fit_tfidf(tf, count_documents(docs), min_df, max_df, max_features)
    return apply_tfidf(tf, model, id_col)


def tfidf_log2(docs: DataFrame, id_col="doc_id", tokens_col="tokens", tf: DataFrame | None = None) -> DataFrame:
    """Second convention (FEA-09): tf x log2(n / df), L2 per document; zero weights dropped.
    ``tf`` may be given precomputed (then ``docs`` is only counted)."""
    tf = term_frequencies(docs, id_col, tokens_col) if tf is None else tf
    dfr = document_frequency(tf).crossJoin(count_documents(docs))
    w = (tf.join(dfr.hint("shuffle_hash"), "term")
         .select(id_col, "term", (F.col("tf") * F.log2(F.col("n_docs") / F.col("df"))).alias("weight"))
         .filter(F.col("weight") != 0))
    return l2_normalise(w, id_col)


# -- n-grams (FEA-03) ---------------------------------------------------------------------------------------
def _not_null_field(name):
    return lambda s: s[name].isNotNull()


def _join_fields(names):
    return lambda s: F.concat_ws(" ", *[s[k] for k in names])


def ngrams(tokens_col: str, n_min: int = 1, n_max: int = 3):
    """All n-grams of ``n_min..n_max`` tokens, joined by one space, as one array column.

    Each order zips the array with its shifted copies (``arrays_zip``), so the token array is read a
    fixed number of times per row rather than once per position.
    """
    t = F.col(tokens_col)
    big = 1 << 30
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(t)
            continue
        shifted = [t.alias("g0")] + [F.slice(t, k + 1, big).alias(f"g{k}") for k in range(1, n)]
        last, fields = f"g{n - 1}", [f"g{k}" for k in range(n)]
        zipped = F.filter(F.arrays_zip(*shifted), _not_null_field(last))
        parts.append(F.transform(zipped, _join_fields(fields)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


class _WordKeys(dict):
    """A 64-bit key a word, 0 for words that are left out; a bounded cache."""
    LIMIT = 1_000_000

    def __init__(self, stop: frozenset, longer_than: int):
        super().__init__()
        self.stop, self.least = stop, longer_than

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        out = 0
        if len(word) > self.least and word not in self.stop:
            out = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") | 1
        self[word] = out
        return out


def _gram_keys(words: np.ndarray, doc: np.ndarray, n_max: int):
    """For each order n: (key, place of the first word) of all runs of n words in one document, from keys of the words and their documents."""
    key, at = words, np.arange(len(words))
    yield 1, key, at
    for n in range(2, n_max + 1):
        if len(at):
            ahead = at + n - 1
            ok = ahead < len(words)
            ok[ok] = doc[ahead[ok]] == doc[at[ok]]
            at, key = at[ok], key[ok]
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[at + n - 1]
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        yield n, key, at


#: Words that a task holds while it counts keys, or spells out n-grams; bits of the table of wanted keys.
KEY_WORDS, GRAM_WORDS, KEY_BITS = 2_000_000, 200_000, 27


def _key_counts(slim: DataFrame, stop: frozenset, longer_than: int, n_max: int) -> DataFrame:
    """(h, df, cf): rows and places of each n-gram key. A key may stand for several n-grams, so both are upper bounds."""
    from ..functions.text import ascii_words

    def count(batches):
        import pyarrow as pa
        cache, parts, size = _WordKeys(stop, longer_than), [], 0

        def flush():
            words = np.concatenate(parts)
            doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            for _, key, at in _gram_keys(words, doc, n_max):
                order = np.argsort(key, kind="stable")          # the documents of a key stay in order
                key, d = key[order], doc[at[order]]
                new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=bool)
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                row = new | np.concatenate(([True], d[1:] != d[:-1]))
                cf = np.diff(np.append(first, len(key)))
                yield pa.record_batch([pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(row, first, dtype=np.int32)),
                                       pa.array(cf.astype(np.int32))], names=["h", "df", "cf"])
        for b in batches:
            for text in b.column(b.num_columns - 1):
                words = ascii_words(text.as_py())
                keys = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
                parts.append(keys[keys != 0])
                size += len(parts[-1])
                if size >= KEY_WORDS:
                    yield from flush()
                    parts, size = [], 0
        if parts:
            yield from flush()
    rows = slim.mapInArrow(count, "h long, df int, cf int")
    # dealt out by key first: rows are combined already, a map-side aggregate would only hold and spill them
    return rows.repartition("h").groupBy("h").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _key_table(keys: DataFrame) -> np.ndarray:
    """A table of 2^27 bits (16 MB whatever the input) with the bit of every wanted key set."""
    place = F.shiftrightunsigned("h", 64 - KEY_BITS).alias("p")
    words = (keys.select(place).groupBy(F.shiftright("p", 6).cast("int").alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow())       # at most 2^21 rows
    table = np.zeros(1 << (KEY_BITS - 6), dtype=np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint64)


def _spelled_counts(slim: DataFrame, table, stop: frozenset, longer_than: int, n_max: int) -> DataFrame:
    """(keys of the row..., term, tf) of the n-grams whose key has its bit in the (broadcast) ``table``."""
    import pyarrow as pa

    from ..functions.text import ascii_words
    from .blockmatrix import to_arrow_schema
    kind = StructType([*slim.schema.fields[:-1], StructField("term", StringType()), StructField("tf", LongType())])
    schema = to_arrow_schema(kind)

    def count(batches):
        cache, bits = _WordKeys(stop, longer_than), table.value

        def rows(batch, texts):
            words = [w for _, t in texts for w in t]
            doc = np.repeat(np.arange(len(texts)), [len(t) for _, t in texts])
            keys, found = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words)), [[] for _ in texts]
            for n, key, at in _gram_keys(keys, doc, n_max):
                place = key >> np.uint64(64 - KEY_BITS)
                at = at[(bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                for i, d in zip(at.tolist(), doc[at].tolist()):
                    found[d].append(words[i] if n == 1 else " ".join(words[i:i + n]))
            counts = [Counter(f) for f in found]
            terms = [t for c in counts for t in c]
            tf = np.fromiter((x for c in counts for x in c.values()), dtype=np.int64, count=len(terms))
            own = pa.array(np.repeat(np.array([i for i, _ in texts], dtype=np.int64), [len(c) for c in counts]))
            columns = [batch.column(i).take(own).cast(schema.field(i).type) for i in range(batch.num_columns - 1)]
            return pa.record_batch([*columns, pa.array(terms, pa.string()), pa.array(tf)], schema=schema)

        for b in batches:
            texts, size = [], 0
            for i, text in enumerate(b.column(b.num_columns - 1)):
                texts.append((i, [w for w in ascii_words(text.as_py()) if cache[w]]))
                size += len(texts[-1][1])
                if size >= GRAM_WORDS:
                    yield rows(b, texts)
                    texts, size = [], 0
            if texts:
                yield rows(b, texts)
    return slim.mapInArrow(count, kind)


def text_ngram_tfidf(docs: DataFrame, text_col: str, stopwords, longer_than: int = 3, n_max: int = 3, min_df=1, max_df=1.0,
                     max_features: int | None = None, id_col: str = "doc_id", slack: float = 0.02) -> DataFrame:
    """TF-IDF over all n-grams of 1..n_max processed tokens (FEA-03), straight from raw text, with the rows of ``tfidf`` on ``ngrams``.

    Most n-grams are dropped by the bounds, so they are first counted by 64-bit keys; only those whose key reaches ``min_df`` and the count
    (a little below that) of the last of ``max_features`` are spelled out, written and counted exactly. Counts by key are upper bounds, so an n-gram that
    is left out cannot be among the most frequent if enough of the others reach that count; where they do not, all that reach ``min_df`` are taken."""
    from ..session import cut_lineage
    stop, least = frozenset(stopwords or []), max(longer_than, 0)
    slim = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    n_docs = count_documents(docs)
    n = n_docs.first().n_docs
    lo, hi = (b if isinstance(b, int) else math.ceil(b * n) if up else b * n for b, up in ((min_df, True), (max_df, False)))
    keys = cut_lineage(_key_counts(slim, stop, least, n_max).filter(F.col("df") >= lo), "gram-keys")
    floors = [0]
    if max_features is not None:
        from pyspark.sql import Window
        counts = keys.filter(F.col("df") <= hi).groupBy("cf").agg(F.count(F.lit(1)).alias("n"))      # one row a count
        upto = F.sum("n").over(Window.orderBy(F.col("cf").desc()))
        last = counts.withColumn("upto", upto).filter(F.col("upto") >= max_features * (1 + slack)).agg(F.max("cf").alias("cf")).first().cf
        floors = [0] if last is None else [last, 0]
    once = no_repeats(docs.select(id_col))
    for floor in floors:
        table = slim.sparkSession.sparkContext.broadcast(_key_table(keys.filter(F.col("cf") >= floor)))
        tf = _spelled_counts(slim, table, stop, least, n_max)
        tf = cut_lineage(tf if once else tf.groupBy(id_col, "term").agg(F.sum("tf").alias("tf")), "tf")
        vocab = cut_lineage(vocabulary(tf, n_docs, min_df, max_df, max_features), "vocabulary")
        if not floor or vocab.filter(F.col("cf") >= floor).count() >= max_features:
            break
    return apply_tfidf(tf, vocab.withColumn("idf", smooth_idf()), id_col)


# -- BM25 (FEA-05 / FEA-06) ---------------------------------------------------------------------------------
def bm25_idf(df_col="df", n_col="n_docs"):
    """ln((n - df + 0.5) / (df + 0.5)); negative for terms in more than half the documents."""
    return F.log((F.col(n_col) - F.col(df_col) + F.lit(0.5)) / (F.col(df_col) + F.lit(0.5)))


def fit_bm25(tf_fit: DataFrame, n_docs: DataFrame, vocab: DataFrame | None = None, k1: float = 2.0, b: float = 0.75,
             use_idf: bool = True, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Fit BM25: returns (idf table (term, df, idf), one-row (avgdl, n_docs)).

    ``vocab`` restricts the terms (the columns of the reference's matrix); ``avgdl`` is the mean in-vocabulary
    document length over all documents, documents without a vocabulary term counting as 0. Both the idf
    and ``avgdl`` come from one per-term table (df, corpus count): when ``vocab`` already carries them (the
    output of ``vocabulary``) the term counts are not read again.
    """
    if vocab is not None and {"df", "cf"} <= set(vocab.columns):
        per_term = vocab.select("term", "df", "cf")
    else:
        base = tf_fit if vocab is None else tf_fit.join(vocab.select("term"), "term")
        per_term = base.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    per_term = per_term.crossJoin(n_docs)
    idf = per_term.select("term", "df", (bm25_idf() if use_idf else F.lit(1.0)).alias("idf"))
    stats = per_term.agg((F.sum("cf") / F.max("n_docs")).alias("avgdl"), F.max("n_docs").alias("n_docs"))
    if vocab is None:
        stats = n_docs.join(stats.drop("n_docs"), how="left").select(
            F.coalesce("avgdl", F.lit(0.0)).alias("avgdl"), "n_docs")
    return idf, stats


def apply_bm25(tf: DataFrame, idf: DataFrame, stats: DataFrame, k1: float = 2.0, b: float = 0.75,
               id_col: str = "doc_id", model_cols=()) -> DataFrame:
    """(doc_id, term, [model_cols of idf...], weight) = tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)) x idf.

    ``dl`` (in-vocabulary length) is a window sum over the document; ``avgdl`` is the fitted scalar."""
    from pyspark.sql import Window
    t = tf.join(idf.select("term", "idf", *model_cols), "term").crossJoin(stats.select("avgdl"))
    dl = F.sum("tf").over(Window.partitionBy(id_col))
    x = F.col("tf").cast("double")
    w = x * F.lit(k1 + 1) / (x + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.col("avgdl")))
    return t.select(id_col, "term", *model_cols, (w * F.col("idf")).alias("weight"))


# -- dense features -----------------------------------------------------------------------------------------
def minmax_scale(df: DataFrame, feature_col: str, value_col: str = "value") -> DataFrame:
    """Per-feature min-max scaling to [0, 1] over a long table (FEA-11); constant features map to 0."""
    mm = df.groupBy(feature_col).agg(F.min(value_col).alias("_mn"), F.max(value_col).alias("_mx"))
    rng = F.col("_mx") - F.col("_mn")
    return (df.join(F.broadcast(mm), feature_col)          # one row a feature
            .withColumn(value_col, F.when(rng > 0, (F.col(value_col) - F.col("_mn")) / rng).otherwise(0.0))
            .drop("_mn", "_mx"))


def max_normalise(df: DataFrame, id_col: str, value_col: str = "value") -> DataFrame:
    """Divide each row by its largest absolute value (``norm='max'``)."""
    from pyspark.sql import Window
    m = F.max(F.abs(value_col)).over(Window.partitionBy(id_col))
    return (df.filter(F.col(id_col).isNotNull()).withColumn("_m", m)
            .withColumn(value_col, F.when(F.col("_m") > 0, F.col(value_col) / F.col("_m")).otherwise(0.0))
            .drop("_m"))


def token_vectors(vocab_ranked: DataFrame, vectors: DataFrame, rank_col="rank", vec_key="vec_id",
                  vec_col="embedding") -> DataFrame:
    """(term, dim, value): the word-vector table in long form."""
    return (vocab_ranked.join(vectors, vocab_ranked[rank_col] == vectors[vec_key])
            .select("term", F.posexplode(vec_col).alias("dim", "value"))
            .withColumn("value", F.col("value").cast("double")))


def pooled_vectors(tf: DataFrame, vec_long: DataFrame, how: str = "mean", id_col: str = "doc_id") -> DataFrame:
    """Mean (or sum) of the vectors of a document's in-vocabulary tokens, each occurrence counted (FEA-12).

    Returns (doc_id, dim, value); documents without a known token have no rows (the reference returns
    an empty vector for them).
    """
    t = tf.join(vec_long, "term")
    if how == "sum":
        agg = F.sum(F.col("tf") * F.col("value"))
    else:
        agg = F.sum(F.col("tf") * F.col("value")) / F.sum("tf")
    return t.groupBy(id_col, "dim").agg(agg.alias("value"))


def vocab_vectors(vocab_ranked: DataFrame, vectors: DataFrame, rank_col="rank", vec_key="vec_id",
                  vec_col="embedding") -> DataFrame:
    """(term, rank, embedding): the word-vector table keyed by term (one row per known term and vector)."""
    return (vocab_ranked.join(vectors, vocab_ranked[rank_col] == vectors[vec_key])
            .select("term", F.col(rank_col).cast("long").alias("rank"), F.col(vec_col).alias("embedding")))


def pooled_vectors_wide(tf: DataFrame, term_vectors: DataFrame, dim: int, how: str = "mean",
                        id_col: str = "doc_id") -> DataFrame:
    """Mean (or sum) word vector per document as (doc_id, dim, value), each occurrence counted (FEA-12).

    Documents are multiplied in blocks with the vectors that a block needs (``blockmatrix``), so neither an entry nor a
    map task's partial sum of a document carries ``dim`` numbers through a shuffle. Null components are left out of the
    sums; a component that no token of the document has is null."""
    import numpy as np
    import pyarrow as pa

    from ..session import cut_lineage
    from .blockmatrix import BlockMatrix, arrow_schema, sum_by_term
    e = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get("embedding", i).cast("double"))
    tv = cut_lineage(term_vectors.select("term", "rank", e.alias("e")), "vectors")
    whole = tv.filter(F.exists("e", lambda x: x.isNull())).isEmpty()
    parts = [F.transform("e", lambda x: F.coalesce(x, F.lit(0.0))), F.array(F.lit(1.0))]         # sums, vectors counted,
    if not whole:
        parts.append(F.transform("e", lambda x: F.when(x.isNull(), 0.0).otherwise(1.0)))         # known components counted
    width = dim + 1 if whole else 2 * dim + 1
    v = cut_lineage(sum_by_term(tv.select(F.col("rank").alias("term"), F.concat(*parts).alias("v")), width), "term-table")
    if v.filter(F.exists("v", lambda x: x != x.cast("float").cast("double"))).isEmpty():
        v = v.withColumn("v", F.col("v").cast("array<float>"))       # the same numbers (vectors are stored as floats), in half the bytes
    known = tv.select("term", F.col("rank").alias("term_index")).distinct()
    entries = cut_lineage(tf.join(known, "term").select(id_col, "term_index", "tf"), "known")
    # vectors are sent once a block that has the term, but a task holds a block several times while it packs it
    matrix = BlockMatrix.build(entries, entries.select(id_col).distinct(), width, id_col, value_col="tf", share=50)
    ddl = f"id {matrix.id_type}, v array<double>"
    schema = arrow_schema(ddl)

    def rows(block, y):
        values = y[:, :dim] / (y[:, dim:dim + 1] if how != "sum" else 1.0)
        none = np.zeros(values.size, dtype=bool) if whole else (y[:, dim + 1:] <= 0).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * dim), pa.array(values.ravel(), mask=none))
        return [pa.array(block.ids, schema.field("id").type), lists]
    out = cut_lineage(matrix.documents(v, width, rows, ddl, ["id", "v"]), "pooled")
    return out.select(F.col("id").alias(id_col), F.posexplode("v").alias("dim", "value"))


def assemble_array(long_df: DataFrame, id_col: str, pos_col: str, value_col: str, out_col: str) -> DataFrame:
    """Long (id, pos, value) -> (id, array ordered by pos)."""
    return (long_df.groupBy(id_col)
            .agg(F.sort_array(F.collect_list(F.struct(pos_col, value_col))).alias("_s"))
            .select(id_col, F.transform("_s", lambda s: s[value_col]).alias(out_col)))
