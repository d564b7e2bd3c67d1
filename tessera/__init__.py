"""tessera — Spark-native curation, text-feature and evaluation operators for labelled document collections.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a ``pyspark.ml`` Estimator/Model)
built from Spark SQL expressions, joins, aggregates and windows so that Catalyst plans it and the
work spreads over the cluster's partitions.
"""

__version__ = "0.1.0"
