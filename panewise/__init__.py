"""Keyed count windows, running state and throughput measures as Spark DataFrame operators."""
