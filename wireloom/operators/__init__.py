"""Operators over documents, feeds and entries."""
