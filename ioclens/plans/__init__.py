"""Registered queries: each is a lazy Spark plan over the driver tables plus
(where SQL can express it) the equivalent DuckDB oracle SQL."""
