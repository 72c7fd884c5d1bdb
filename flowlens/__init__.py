"""flowlens — Spark-native network-flow detection analytics.

Every step is a lazy ``DataFrame -> DataFrame`` function; fitted statistics
are small parameter DataFrames (one row or one row per feature) that are
broadcast-joined back, so the same code serves batch and streaming.
"""

__version__ = "0.1.0"
