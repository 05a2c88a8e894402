"""Readers and writers. Formats are declared with schemas; nothing is inferred."""
