"""Readers, dump and restore."""
