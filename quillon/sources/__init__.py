"""Readers and writers for the text and binary formats."""
