"""Batch analytics over threaded discussions, written as Spark DataFrame jobs."""
