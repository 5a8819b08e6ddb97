"""Readers, sinks, caches and run settings."""
