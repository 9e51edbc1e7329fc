"""Readers and writers: raw files, lake, warehouse, live events and keyed tables."""
