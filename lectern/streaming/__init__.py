"""Structured Streaming forms of the incremental plans."""

from lectern.streaming.tables import latest_by_key, new_files, session_counts, upsert_stream

__all__ = ["latest_by_key", "new_files", "session_counts", "upsert_stream"]
