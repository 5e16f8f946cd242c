"""Streaming forms of the engine's operators."""
