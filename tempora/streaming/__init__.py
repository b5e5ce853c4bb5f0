"""Structured Streaming forms of the monthly means, the incremental merge and the rate check."""
