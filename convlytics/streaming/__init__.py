"""Incremental (Structured Streaming) entry points for the append-only stores."""
