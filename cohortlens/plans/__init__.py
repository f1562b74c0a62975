"""Composed jobs and the query catalogue used by ``__spark_entry__``."""
