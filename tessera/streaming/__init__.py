"""Incremental extraction with Structured Streaming (STM-01, STM-02)."""
