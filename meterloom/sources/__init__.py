"""Scans, sinks and the yearly resource manifest."""
