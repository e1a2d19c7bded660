"""Readers, writers and load bookkeeping."""
