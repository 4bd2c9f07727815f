"""Readers, writers and bindings."""
