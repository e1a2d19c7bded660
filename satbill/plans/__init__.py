"""Bound queries: the library's operators over the provided tables, each with a checking SQL text."""
