"""Structured Streaming twins of jobs that keep state over time."""
