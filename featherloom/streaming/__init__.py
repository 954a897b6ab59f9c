"""The incremental form of flows and counts, on Structured Streaming."""
