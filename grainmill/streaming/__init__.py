"""Structured Streaming operators over an event table."""
