"""Incremental runs with Structured Streaming: each start takes what is new and stops."""
