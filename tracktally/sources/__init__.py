"""Readers and writers: track text, CSV tables, polygons, draws."""
