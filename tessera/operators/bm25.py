"""BM25 as a ``pyspark.ml`` Estimator / Model over token arrays (FEA-05, FEA-06, UDF-02).

``fit`` learns the vocabulary (document-frequency bounds), the BM25 idf and the average document length;
``transform`` returns the long weight table (id, term, weight). Defaults follow the reference: k1 = 2.0,
b = 0.75, signed idf ln((n - df + .5) / (df + .5)); ``avgdl`` is frozen at fit (Q5).
"""

from __future__ import annotations

import json
import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as fe


class _BM25Params(HasInputCol):
    k1 = Param(Params._dummy(), "k1", "term-frequency saturation", TypeConverters.toFloat)
    b = Param(Params._dummy(), "b", "length normalisation", TypeConverters.toFloat)
    useIdf = Param(Params._dummy(), "useIdf", "multiply by the BM25 idf", TypeConverters.toBoolean)
    minDF = Param(Params._dummy(), "minDF", "min document frequency (int count or float fraction)", TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "max document frequency (int count or float fraction)", TypeConverters.toFloat)
    idCol = Param(Params._dummy(), "idCol", "document id column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(k1=2.0, b=0.75, useIdf=True, minDF=1.0, maxDF=1.0, idCol="doc_id", inputCol="tokens")


def _min_bound(v: float):
    """minDF: values >= 1 are document counts, smaller ones fractions."""
    return int(v) if v >= 1 else float(v)


def _max_bound(v: float):
    """maxDF: values <= 1 are fractions of the documents, larger ones counts."""
    return float(v) if v <= 1 else int(v)


class BM25(Estimator, _BM25Params):
    @keyword_only
    def __init__(self, *, inputCol="tokens", idCol="doc_id", k1=2.0, b=0.75, useIdf=True, minDF=1.0, maxDF=1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BM25Model":
        idc, tok = self.getOrDefault("idCol"), self.getOrDefault("inputCol")
        docs = dataset.select(idc, tok)
        tf = fe.term_frequencies(docs, idc, tok)
        n = fe.count_documents(docs)
        vocab = fe.vocabulary(tf, n, _min_bound(self.getOrDefault("minDF")), _max_bound(self.getOrDefault("maxDF")))
        idf, stats = fe.fit_bm25(tf, n, vocab, use_idf=self.getOrDefault("useIdf"), id_col=idc)
        avgdl = stats.first()["avgdl"]          # one scalar of the fitted model
        m = BM25Model(idf=idf, avgdl=avgdl)
        return self._copyValues(m)


class BM25Model(Model, _BM25Params):
    def __init__(self, idf: DataFrame | None = None, avgdl: float | None = None):
        super().__init__()
        self.idf, self.avgdl = idf, avgdl

    def _transform(self, dataset: DataFrame) -> DataFrame:
        idc, tok = self.getOrDefault("idCol"), self.getOrDefault("inputCol")
        tf = fe.term_frequencies(dataset.select(idc, tok), idc, tok).join(self.idf.select("term"), "term")
        stats = dataset.sparkSession.createDataFrame([(float(self.avgdl),)], "avgdl double")
        return fe.apply_bm25(tf, self.idf, stats, self.getOrDefault("k1"), self.getOrDefault("b"), idc)

    def save(self, path: str) -> None:
        self.idf.write.mode("overwrite").parquet(os.path.join(path, "idf"))
        params = {p.name: self.getOrDefault(p) for p in self.params if self.hasDefault(p) or self.isSet(p)}
        meta = self.idf.sparkSession.createDataFrame([(json.dumps(params), float(self.avgdl))], "params string, avgdl double")
        meta.write.mode("overwrite").json(os.path.join(path, "meta"))

    @classmethod
    def load(cls, spark, path: str) -> "BM25Model":
        meta = spark.read.json(os.path.join(path, "meta")).first()
        m = cls(idf=spark.read.parquet(os.path.join(path, "idf")), avgdl=meta["avgdl"])
        m._set(**json.loads(meta["params"]))
        return m
