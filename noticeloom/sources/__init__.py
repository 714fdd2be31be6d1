"""Readers of stored tables, pages and attachment containers."""
