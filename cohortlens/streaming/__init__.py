"""Change streams applied with Structured Streaming."""
