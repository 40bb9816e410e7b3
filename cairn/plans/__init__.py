"""Written stages, ranks and the query catalogue."""
