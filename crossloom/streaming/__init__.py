"""Structured Streaming forms of keyed upserts and tumbling counts."""

from .events import counted_windows, upsert_store, upsert_stream

__all__ = ["counted_windows", "upsert_store", "upsert_stream"]
