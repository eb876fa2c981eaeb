"""Readers, writers, snapshots and renderers."""
