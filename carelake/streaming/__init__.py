"""Structured Streaming: session state and scheduled re-collection."""
