"""Block-by-block processing with Structured Streaming."""
