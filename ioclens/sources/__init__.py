"""Scans, derived views, file readers (bulk, feeds, datasets) and sinks."""
