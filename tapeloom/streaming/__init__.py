"""Structured Streaming jobs for live bars and events."""
