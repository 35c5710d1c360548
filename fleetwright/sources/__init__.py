"""Readers for fleet tables, change feeds and plugin source files."""
