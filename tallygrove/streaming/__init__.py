"""Structured Streaming: event windows, deduplication, latest state, rolling replay."""
