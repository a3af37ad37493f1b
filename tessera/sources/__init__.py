"""Readers and writers of tables, links, pages and semantic models."""
