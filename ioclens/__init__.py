"""ioclens: Spark-native analytics over security indicators (IOCs).

Every public operator is a ``DataFrame -> DataFrame`` function built from
Catalyst expressions, joins, windows and aggregates, so plans stay lazy and
run distributed on the cluster that owns the session.
"""

__all__ = ["session"]
