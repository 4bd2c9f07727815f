"""Structured Streaming forms of interval upkeep and the watchdog."""
