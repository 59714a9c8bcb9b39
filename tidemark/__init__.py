"""Replay and query the history of a transactional, multi-version key-value store on Spark."""
