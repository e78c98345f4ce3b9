"""The operators as running Structured Streaming queries."""
