"""Event-driven operators on Structured Streaming."""
