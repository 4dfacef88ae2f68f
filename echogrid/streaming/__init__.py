"""Structured Streaming forms of announcements, readiness and state."""
