"""Structured Streaming jobs. Each is started with a checkpoint folder of its own."""
