"""Structured Streaming over audit logs and data tables."""
