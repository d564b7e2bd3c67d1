"""Text-layer queries over ``documents``, ``pages`` and ``embeddings`` (STR-*, FLT-03, FEA-*, AGG-17)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import stem as stem_mod
from ..functions import stopwords as sw
from ..functions import text as tx
from ..functions.entities import sql_decode_references
from ..operators import common, features as fe
from ..session import cut_lineage
from ..sources.tables import table
from . import sqlfrag as q
from .registry import query

# Stand-in stop list: the corpus is en/fr/de/es, the reference's is Portuguese; all five, folded.
STOP = sw.folded_set("english", "french", "german", "spanish", "portuguese")
# Word-frequency stop list: folded Portuguese list plus the fixed domain words (ANA word clouds).
WF_STOP = sw.folded_set("portuguese", extra=sw.DOMAIN_STOPWORDS)
BAND_LO, BAND_HI = 400, 10000          # open interval (Q18)
MIN_DF, MAX_DF = 5, 0.8
TOP_TERMS = 20
WORDS_PER_CLASS = 200


def processed_docs(spark, sf, band: bool = False, materialize: bool = False):
    """(doc_id, lang, source, tokens). With ``materialize`` the processed corpus is written once to the
    shared checkpoint folder (as the reference hands its processed corpus to the feature stage), so the
    regex work is not repeated by every consumer of the token table (vocabulary, weights, counts)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    if band:
        wc = tx.word_count("text")
        d = d.filter((wc > BAND_LO) & (wc < BAND_HI))
    d = d.select("doc_id", "lang", "source", tx.processed_tokens("text", STOP, 3).alias("tokens"))
    return cut_lineage(d) if materialize else d


def _sql_stop_list(words) -> str:
    return "[" + ", ".join(q.lit(w) for w in words) + "]"


def sql_doc_tokens(name: str = "doc_tok", band: bool = False, stop=STOP, longer_than: int = 3,
                   keep: str = "doc_id, lang, source") -> str:
    where = (f"WHERE {q.word_count('text')} > {BAND_LO} AND {q.word_count('text')} < {BAND_HI}" if band else "")
    return (f"{name} AS (SELECT {keep}, list_filter(string_split({q.token_string('text')}, ' '), "
            f"lambda x: length(x) > {longer_than} AND NOT list_contains({_sql_stop_list(stop)}, x)) AS tokens "
            f"FROM documents {where})")


SQL_TFIDF_CORE = """
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM doc_tok) GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n_docs FROM doc_tok),
voc AS (SELECT term, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), nd
        WHERE df >= {min_df} AND df <= {max_df} * n_docs),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN voc USING (term)),
tfidf AS (SELECT doc_id, term, CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END AS weight
          FROM w JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id) USING (doc_id))
"""


# -- flagship ---------------------------------------------------------------------------------------------
def band_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return d.filter(F.abs(2 * tx.word_count("text") - (BAND_LO + BAND_HI)) < BAND_HI - BAND_LO)        # words are counted once: lo < n < hi


def doc_term_counts(spark, sf, band: bool = False, keys=("doc_id",)):
    """Materialised (doc, term, tf) table of the processed corpus (one pass over the text), and the
    document table it came from (for the document count, which prunes the text column away)."""
    every = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    d = band_docs(spark, sf) if band else every
    once = fe.no_repeats(every.select(*keys))           # of the whole table: the band's words are not counted for it
    return cut_lineage(fe.text_term_counts(d, "text", STOP, 3, keys, once=once), "tf"), d


def class_top_terms_df(spark, sf):
    tf, docs = doc_term_counts(spark, sf, band=True, keys=("doc_id", "lang"))
    model = fe.fit_tfidf(tf, fe.count_documents(docs), MIN_DF, MAX_DF)
    weights = fe.apply_tfidf(tf, model, keep=("lang",), hashed=True)
    per_class = weights.groupBy("lang", "term").agg(F.sum("weight").alias("score_raw"))
    ranked = common.top_k_per_group(per_class, "lang", [F.round("score_raw", 9).desc(), F.col("term")],
                                    TOP_TERMS, salt_col="term")
    return ranked.select("lang", "term", F.round("score_raw", 6).alias("score"), F.col("rank").cast("int"))


SQL_CLASS_TOP_TERMS = f"""
WITH {sql_doc_tokens(band=True)},
{SQL_TFIDF_CORE.format(min_df=MIN_DF, max_df=MAX_DF)},
pc AS (SELECT lang, term, sum(weight) AS s FROM tfidf JOIN doc_tok USING (doc_id) GROUP BY lang, term),
rk AS (SELECT lang, term, s, row_number() OVER (PARTITION BY lang ORDER BY round(s, 9) DESC, term) AS rank FROM pc)
SELECT lang, term, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {TOP_TERMS}
"""


@query("class_top_terms", SQL_CLASS_TOP_TERMS,
       ops=("STR-02", "STR-03", "STR-04", "STR-05", "STR-09", "FLT-03", "FEA-01", "FEA-02", "AGG-17", "WIN-05"))
def class_top_terms(spark, sf):
    """Flagship: band-filtered documents -> TF-IDF -> top terms per class by summed weight."""
    return class_top_terms_df(spark, sf)


# -- length bands (FLT-03, STR-09) ----------------------------------------------------------------------
@query("length_bands", f"""
SELECT CAST(floor(wc / 100) * 100 AS BIGINT) AS band_start, count(*) AS n_docs,
       CAST(sum(CASE WHEN wc > {BAND_LO} AND wc < {BAND_HI} THEN 1 ELSE 0 END) AS BIGINT) AS n_in_band
FROM (SELECT {q.word_count('text')} AS wc FROM documents) GROUP BY 1
""", ops=("STR-09", "FLT-03", "AGG-01"))
def length_bands(spark, sf):
    d = table(spark, sf, "documents").select(tx.word_count("text").alias("wc"))
    inband = (F.col("wc") > BAND_LO) & (F.col("wc") < BAND_HI)
    return (d.groupBy((F.floor(F.col("wc") / 100) * 100).cast("long").alias("band_start"))
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(inband.cast("long")).alias("n_in_band")))


@query("band_filter", f"""
SELECT doc_id, lang, wc AS word_count FROM (SELECT doc_id, lang, {q.word_count('text')} AS wc FROM documents)
WHERE wc > {BAND_LO} AND wc < {BAND_HI}
""", ops=("FLT-03", "STR-09"))
def band_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", tx.word_count("text").alias("word_count"))
    return d.filter((F.col("word_count") > BAND_LO) & (F.col("word_count") < BAND_HI))


# -- normalisation ---------------------------------------------------------------------------------------
@query("normalize_text", f"""
WITH {sql_doc_tokens()}
SELECT doc_id, array_to_string(tokens, ' ') AS processed, CAST(len(tokens) AS INTEGER) AS n_tokens FROM doc_tok
""", ops=("STR-02", "STR-03", "STR-04", "STR-05", "UDF-01"))
def normalize_text(spark, sf):
    d = processed_docs(spark, sf)
    return d.select("doc_id", tx.join_tokens("tokens").alias("processed"), F.size("tokens").alias("n_tokens"))


@query("light_clean", f"""
SELECT doc_id, {q.letters_lower('text')} AS cleaned FROM documents
""", ops=("STR-07", "STR-02"))
def light_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.letters_lower("text").alias("cleaned"))


_SQL_HTML = "regexp_replace(html, '[\\n\\t]', ' ', 'g')"
for _p in ("(?is)<script\\b.*?</script\\s*>", "(?is)<style\\b.*?</style\\s*>", "(?s)<!--.*?-->", "<[^>]*>"):
    _SQL_HTML = f"regexp_replace({_SQL_HTML}, {q.lit(_p)}, ' ', 'g')"
_SQL_HTML = f"trim(regexp_replace({sql_decode_references(_SQL_HTML)}, '[ \\t\\n\\r\\f\\x0B\\xA0]+', ' ', 'g'))"


@query("html_to_text", f"SELECT page_id, {_SQL_HTML} AS text FROM pages", ops=("STR-01",))
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_text("html").alias("text"))


@query("page_tokens", f"""
WITH p AS (SELECT page_id, {_SQL_HTML} AS text FROM pages)
SELECT page_id, CAST(len(list_filter(string_split({q.token_string('text')}, ' '), lambda x: length(x) > 3
       AND NOT list_contains({_sql_stop_list(STOP)}, x))) AS INTEGER) AS n_tokens FROM p
""", ops=("STR-01", "STR-02", "STR-03", "STR-04", "STR-05"))
def page_tokens(spark, sf):
    p = table(spark, sf, "pages").select("page_id", tx.html_to_text("html").alias("text"))
    return p.select("page_id", F.size(tx.processed_tokens("text", STOP, 3)).alias("n_tokens"))


@query("glove_clean", None, ops=("STR-08",))
def glove_clean(spark, sf):
    """Ordered cleaning for word-vector corpora; uses look-around patterns RE2 lacks, so rows-only."""
    return table(spark, sf, "documents").select("doc_id", tx.clean_for_embeddings("text").alias("cleaned"))


# -- stemming as a vocabulary job (STR-06) ----------------------------------------------------------------
def stem_vocabulary(docs):
    vocab = docs.select(F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull()).distinct()
    return stem_mod.stem_column(vocab, "token", "stem")


_STEM_CTES, _STEM_LAST = stem_mod.sql_stem_ctes("voc", "token")


@query("stem_vocab", f"""
WITH {sql_doc_tokens()},
voc AS (SELECT DISTINCT unnest(tokens) AS token FROM doc_tok),
{_STEM_CTES}
SELECT token, stem FROM {_STEM_LAST}
""", ops=("STR-06",))
def stem_vocab(spark, sf):
    d = table(spark, sf, "documents").select("text")
    vocab = fe.text_term_counts(d, "text", STOP, 3, keys=()).select(F.col("term").alias("token"))
    return stem_mod.stem_column(vocab, "token", "stem")


@query("stemmed_text", f"""
WITH {sql_doc_tokens()},
pos AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM doc_tok),
voc AS (SELECT DISTINCT token FROM pos),
{_STEM_CTES}
SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS stemmed
FROM pos JOIN {_STEM_LAST} USING (token) GROUP BY doc_id
""", ops=("STR-06", "UDF-01"))
def stemmed_text(spark, sf):
    """Stems per distinct token, joined back to positions and re-assembled per document in order."""
    docs = processed_docs(spark, sf)
    stems = stem_vocabulary(docs)
    pos = docs.select("doc_id", F.posexplode_outer("tokens").alias("pos", "token")).filter(F.col("token").isNotNull())
    joined = pos.join(stems, "token")
    return fe.assemble_array(joined, "doc_id", "pos", "stem", "_st").select(
        "doc_id", F.array_join("_st", " ").alias("stemmed"))


# -- TF-IDF family (FEA-01..04, 08, 09) -------------------------------------------------------------------
@query("tfidf", f"""
WITH {sql_doc_tokens()},
{SQL_TFIDF_CORE.format(min_df=MIN_DF, max_df=MAX_DF)}
SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf
""", ops=("FEA-01", "FEA-02", "FEA-04"))
def tfidf(spark, sf):
    tf, docs = doc_term_counts(spark, sf)
    w = fe.apply_tfidf(tf, fe.fit_tfidf(tf, fe.count_documents(docs), MIN_DF, MAX_DF))
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("stemmed_band_tfidf", f"""
WITH doc_tok AS (
  WITH {sql_doc_tokens().replace("doc_tok", "raw_tok")},
  pos AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM raw_tok),
  voc AS (SELECT DISTINCT token FROM pos),
  {_STEM_CTES}
  SELECT doc_id, list(stem ORDER BY pos) AS tokens FROM pos JOIN {_STEM_LAST} USING (token) GROUP BY doc_id
  HAVING count(*) > {BAND_LO} AND count(*) < {BAND_HI}),
{SQL_TFIDF_CORE.format(min_df=MIN_DF, max_df=MAX_DF)}
SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf
""", ops=("FLT-03", "STR-06", "STR-09", "FEA-01", "FEA-02"))
def stemmed_band_tfidf(spark, sf):
    """The whole preparation in its order: normalise, stem, keep the documents whose processed text is in the length band, TF-IDF over stems."""
    tf, _ = doc_term_counts(spark, sf)
    vocab = cut_lineage(stem_mod.stem_column(tf.select(F.col("term").alias("token")).distinct(), "token", "stem"), "stemmed-words")
    entries = tf.filter(F.col("doc_id").isNotNull()).join(vocab, F.col("term") == F.col("token"))
    # one shuffle by document serves the sums by stem and the length of the document, and the table is written once
    stems = entries.select("doc_id", "stem", "tf").repartition("doc_id").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    words = F.sum("tf").over(Window.partitionBy("doc_id"))
    kept = stems.withColumn("words", words).filter((F.col("words") > BAND_LO) & (F.col("words") < BAND_HI)).drop("words")
    kept = cut_lineage(kept, "stems")
    words = kept.select("doc_id").distinct()
    w = fe.apply_tfidf(kept, fe.fit_tfidf(kept, fe.count_documents(words), MIN_DF, MAX_DF))
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_norms", f"""
WITH {sql_doc_tokens()},
{SQL_TFIDF_CORE.format(min_df=MIN_DF, max_df=MAX_DF)}
SELECT doc_id, round(sqrt(sum(weight * weight)), 6) AS norm, count(*) AS n_terms FROM tfidf GROUP BY doc_id
""", ops=("FEA-02",))
def tfidf_norms(spark, sf):
    """Property check as a query: every document's TF-IDF vector has norm 1."""
    tf, docs = doc_term_counts(spark, sf)
    w = fe.apply_tfidf(tf, fe.fit_tfidf(tf, fe.count_documents(docs), MIN_DF, MAX_DF))
    return w.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("weight") ** 2)), 6).alias("norm"),
                                   F.count(F.lit(1)).alias("n_terms"))


NGRAM_MIN_DF, NGRAM_MAX_DF, NGRAM_MAX_FEATURES = 10, 0.8, 150000


def _sql_ngrams(n: int) -> str:
    return (f"SELECT doc_id, array_to_string(tokens[i:i + {n - 1}], ' ') AS term "
            f"FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) - {n - 2})) AS i FROM doc_tok "
            f"WHERE len(tokens) >= {n})")


@query("tfidf_ngrams", f"""
WITH {sql_doc_tokens()},
grams AS ({_sql_ngrams(1)} UNION ALL {_sql_ngrams(2)} UNION ALL {_sql_ngrams(3)}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n_docs FROM doc_tok),
v0 AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
v1 AS (SELECT term, df, cf, n_docs FROM v0, nd WHERE df >= {NGRAM_MIN_DF} AND df <= {NGRAM_MAX_DF} * n_docs
       ORDER BY cf DESC, term LIMIT {NGRAM_MAX_FEATURES}),
voc AS (SELECT term, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf FROM v1),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN voc USING (term)),
tfidf AS (SELECT doc_id, term, CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END AS weight
          FROM w JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id) USING (doc_id))
SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf
""", ops=("FEA-03",))
def tfidf_ngrams(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    w = fe.text_ngram_tfidf(docs, "text", STOP, 3, 3, NGRAM_MIN_DF, NGRAM_MAX_DF, NGRAM_MAX_FEATURES)
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_log2", f"""
WITH {sql_doc_tokens()},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM doc_tok) GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n_docs FROM doc_tok),
dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * log2(n_docs / df) AS w FROM tf JOIN dfr USING (term), nd),
w2 AS (SELECT * FROM w WHERE w <> 0)
SELECT doc_id, term, round(CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END, 6) AS weight
FROM w2 JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w2 GROUP BY doc_id) USING (doc_id)
""", ops=("FEA-09",))
def tfidf_log2(spark, sf):
    tf, docs = doc_term_counts(spark, sf)
    w = fe.tfidf_log2(docs, tf=tf)
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("bow", f"""
WITH {sql_doc_tokens()},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM doc_tok) GROUP BY doc_id, term),
ix AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_index FROM (SELECT DISTINCT term FROM tf))
SELECT doc_id, term_index, tf AS count FROM tf JOIN ix USING (term)
""", ops=("FEA-08", "AGG-01"))
def bow(spark, sf):
    """Dictionary (dense sorted term ids) and bag of words per document."""
    tf, _ = doc_term_counts(spark, sf)
    terms = cut_lineage(tf.select("term").distinct(), "terms")          # read for the buckets' sizes and for the numbers
    return tf.join(common.dense_index(terms, "term", "term_index"), "term").select("doc_id", "term_index", F.col("tf").alias("count"))


# -- BM25 (FEA-05, FEA-06) --------------------------------------------------------------------------------
BM25_K1, BM25_B = 2.0, 0.75


@query("bm25", f"""
WITH {sql_doc_tokens()},
tf0 AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM doc_tok) GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n_docs FROM doc_tok),
voc AS (SELECT term FROM (SELECT term, count(*) AS df FROM tf0 GROUP BY term), nd
        WHERE df >= {MIN_DF} AND df <= {MAX_DF} * n_docs),
tf AS (SELECT * FROM tf0 JOIN voc USING (term)),
idf AS (SELECT term, ln((n_docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), nd),
st AS (SELECT sum(tf) / max(n_docs) AS avgdl FROM tf, nd),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id)
SELECT doc_id, term,
       round(tf * {BM25_K1 + 1} / (tf + {BM25_K1} * ({1 - BM25_B} + {BM25_B} * dl / avgdl)) * idf, 6) AS weight
FROM tf JOIN idf USING (term) JOIN dl USING (doc_id), st
""", ops=("FEA-05", "FEA-06"))
def bm25(spark, sf):
    tf, docs = doc_term_counts(spark, sf)
    n = fe.count_documents(docs)
    vocab = fe.vocabulary(tf, n, MIN_DF, MAX_DF)
    idf, stats = fe.fit_bm25(tf, n, vocab, BM25_K1, BM25_B)
    w = fe.apply_bm25(tf, idf, stats, BM25_K1, BM25_B)        # idf holds the vocabulary's terms alone: one join
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# -- word vectors (FEA-12) and scaling (FEA-11) -------------------------------------------------------------
def ranked_vocab(tf):
    """Token -> vec_id stand-in: rank of the term by (document frequency desc, term)."""
    dfr = fe.document_frequency(tf)
    return common.dense_index(dfr, "term", "rank",
                              order=[(F.col("df"), False), (F.col("term"), True)],
                              buckets=[(F.col("df"), False), (F.substring("term", 1, 1), True)])


SQL_VEC_BASE = f"""
WITH {sql_doc_tokens()},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM doc_tok) GROUP BY doc_id, term),
rv AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS rank FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)),
vl AS (SELECT term, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value
       FROM rv JOIN embeddings ON rv.rank = embeddings.vec_id)
"""


@query("mean_vector", SQL_VEC_BASE + """
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(sum(tf * value) / sum(tf), 6) AS value FROM tf JOIN vl USING (term) GROUP BY doc_id, dim
""", ops=("FEA-12",))
def mean_vector(spark, sf):
    tf, _ = doc_term_counts(spark, sf)
    return _pooled(spark, sf, tf, "mean").select("doc_id", "dim", F.round("value", 6).alias("value"))


def _pooled(spark, sf, tf, how):
    emb = table(spark, sf, "embeddings")
    dim = emb.agg(F.max(F.size("embedding"))).first()[0]     # the vectors' length: a model property
    tv = fe.vocab_vectors(ranked_vocab(tf), emb)
    return fe.pooled_vectors_wide(tf, tv, int(dim), how)


@query("sum_vector", SQL_VEC_BASE + """
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(sum(tf * value), 6) AS value FROM tf JOIN vl USING (term) GROUP BY doc_id, dim
""", ops=("FEA-12",))
def sum_vector(spark, sf):
    tf, _ = doc_term_counts(spark, sf)
    return _pooled(spark, sf, tf, "sum").select("doc_id", "dim", F.round("value", 6).alias("value"))


@query("minmax_scale", SQL_VEC_BASE + """,
mv AS (SELECT doc_id, dim, sum(tf * value) / sum(tf) AS value FROM tf JOIN vl USING (term) GROUP BY doc_id, dim),
mm AS (SELECT dim, min(value) AS mn, max(value) AS mx FROM mv GROUP BY dim)
SELECT doc_id, CAST(dim AS INTEGER) AS dim,
       round(CASE WHEN mx - mn > 0 THEN (value - mn) / (mx - mn) ELSE 0.0 END, 6) AS value
FROM mv JOIN mm USING (dim)
""", ops=("FEA-11",))
def minmax_scale(spark, sf):
    tf, _ = doc_term_counts(spark, sf)
    mv = _pooled(spark, sf, tf, "mean")
    return fe.minmax_scale(mv, "dim").select("doc_id", "dim", F.round("value", 6).alias("value"))


@query("max_normalize", SQL_VEC_BASE + """,
mv AS (SELECT doc_id, dim, sum(tf * value) AS value FROM tf JOIN vl USING (term) GROUP BY doc_id, dim),
mx AS (SELECT doc_id, max(abs(value)) AS m FROM mv GROUP BY doc_id)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN m > 0 THEN value / m ELSE 0.0 END, 6) AS value
FROM mv JOIN mx USING (doc_id)
""", ops=("FEA-11",))
def max_normalize(spark, sf):
    tf, _ = doc_term_counts(spark, sf)
    mv = _pooled(spark, sf, tf, "sum")
    return fe.max_normalise(mv, "doc_id").select("doc_id", "dim", F.round("value", 6).alias("value"))


# -- word frequencies per class (AGG-17) -----------------------------------------------------------------
@query("word_freq_by_class", f"""
WITH t AS (SELECT lang, unnest(string_split({q.token_string('text')}, ' ')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS freq FROM t
      WHERE length(word) >= 2 AND NOT list_contains({_sql_stop_list(WF_STOP)}, word) GROUP BY lang, word),
r AS (SELECT lang, word, freq, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS rank FROM c)
SELECT lang, word, freq, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {WORDS_PER_CLASS}
""", ops=("AGG-17", "STR-07"))
def word_freq_by_class(spark, sf):
    d = table(spark, sf, "documents").select(
        "lang", F.explode_outer(F.split(tx.token_string("text"), " ")).alias("word"))
    c = (d.filter((F.length("word") >= 2) & ~F.col("word").isin(WF_STOP))
         .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("freq")))
    r = common.top_k_per_group(c, "lang", [F.col("freq").desc(), F.col("word")], WORDS_PER_CLASS, salt_col="word")
    return r.select("lang", "word", "freq", F.col("rank").cast("int"))


# -- identifiers (STR-10..12) -----------------------------------------------------------------------------
@query("case_number", """
SELECT o_orderkey,
       lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || '.' ||
       lpad(CAST(year(o_orderdate) AS VARCHAR), 4, '0') || '.5.' || lpad(CAST(o_custkey % 24 + 1 AS VARCHAR), 2, '0') || '.' ||
       lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS case_number,
       right(lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), 4) AS tail4,
       CAST(left(lpad(CAST(o_custkey % 24 + 1 AS VARCHAR), 2, '0'), 1) AS INTEGER) AS region_first_digit,
       lpad(CAST(o_custkey % 24 + 1 AS VARCHAR), 2, '0') AS region_code
FROM orders
""", ops=("STR-10", "STR-11", "STR-12", "NUM-01", "PRJ-01", "PRJ-03"))
def case_number(spark, sf):
    o = table(spark, sf, "orders")
    region = F.col("o_custkey") % 24 + 1
    num = tx.case_number("o_orderkey", F.col("o_custkey") % 100, F.year("o_orderdate"), F.lit(5), region,
                         F.col("o_orderkey") % 10000)
    seq = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    return o.select("o_orderkey", num.alias("case_number"), F.right(seq, F.lit(4)).alias("tail4"),
                    F.left(tx.region_code(region), F.lit(1)).cast("int").alias("region_first_digit"),
                    tx.region_code(region).alias("region_code"))
