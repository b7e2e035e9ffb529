"""Timed-text jobs on Spark."""
