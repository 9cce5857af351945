"""Readers, writers and adapters to the long observation layout."""
