"""Structured Streaming: event coalescing and index refresh."""
