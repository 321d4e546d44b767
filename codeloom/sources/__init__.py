"""Readers of tables and source text."""
