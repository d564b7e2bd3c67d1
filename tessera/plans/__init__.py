"""Query plans over the driver tables: each registered query is ``(spark, sf_dir) -> DataFrame``, with an
equivalent DuckDB SQL text where one can be written (the correctness oracle)."""

from .registry import QUERIES, ORACLE, query  # noqa: F401
