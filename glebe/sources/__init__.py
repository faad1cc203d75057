"""Readers of landed files and tables, and their writers."""
