"""Readers and writers: driver tables, regional CSV corpora, relational range scans, sinks."""
