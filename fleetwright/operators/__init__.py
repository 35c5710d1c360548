"""Batch operators over fleet tables."""
