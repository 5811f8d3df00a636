"""Readers and parsers that turn semi-structured text into rows."""
