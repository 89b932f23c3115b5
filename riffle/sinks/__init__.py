"""Sinks: reports, artifacts and caches."""
