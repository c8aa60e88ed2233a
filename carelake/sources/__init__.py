"""Landed files, snapshots and append-only tables."""
