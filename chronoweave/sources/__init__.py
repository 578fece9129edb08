"""Readers, writers and format probes."""
