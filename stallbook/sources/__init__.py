"""Readers for files and tables."""
