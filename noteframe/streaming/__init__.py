"""Incremental (streaming) variants. The reference has no streaming
operators; the one incremental step, the annotated-note register (A10), is
offered as a Structured Streaming job."""
