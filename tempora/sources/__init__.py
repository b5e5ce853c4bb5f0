"""Readers, payload parsers, sinks and the adapter for the star-schema tables."""
