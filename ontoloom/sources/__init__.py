"""Readers and writers of tables and files."""
