"""Relational steps of annotation: links, flows, candidate relations, features, inference and selection."""
