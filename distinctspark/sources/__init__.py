"""Readers and writers: event CSV, sketch state, measurement files."""
