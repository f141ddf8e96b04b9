"""Readers, validation, artifacts and stream sinks."""
