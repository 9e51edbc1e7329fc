"""Retail sales analytics as PySpark DataFrame functions and Structured Streaming jobs."""
