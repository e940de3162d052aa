"""Readers, table writers, the catalog and read-only SQL."""
