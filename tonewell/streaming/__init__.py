"""Incremental versions of the batch jobs on Structured Streaming."""
