"""Queues and keyed state on Structured Streaming."""
