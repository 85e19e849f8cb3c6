"""Structured Streaming: the append-following source and running state."""
