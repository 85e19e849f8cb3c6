"""Readers and synthetic corpora that produce lines."""
