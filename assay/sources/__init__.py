"""Readers and writers: tables, shared scratch space, audit logs."""
