"""Spark-native analytics over text memory."""

from . import queries, service_queries  # noqa: F401  each module registers its own
