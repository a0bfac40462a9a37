"""Structured Streaming: sources, continuously maintained tables, sinks and
stateful alert holds."""
