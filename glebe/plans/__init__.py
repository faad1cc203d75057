"""Composed jobs from landed files to tables and reports."""
