"""Structured Streaming forms of the log tail, the schedule and the capture tap."""
