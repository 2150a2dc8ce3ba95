"""Readers, harmonisation and sinks."""
