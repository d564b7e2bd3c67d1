"""Operators of a training-data pipeline, each built by its own method as Spark jobs.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; ``queries``
registers one ``opN_<name>`` query per operator over the driver tables.
"""
