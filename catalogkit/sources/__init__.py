"""Readers and writers of the catalogue's tables and documents."""
