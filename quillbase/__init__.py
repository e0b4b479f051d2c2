"""Versioned, typed record analytics on Spark."""
