"""Row-local operators on Structured Streaming."""
