"""DataFrame -> DataFrame operators (joins, upserts, windows, graph, ML)."""
