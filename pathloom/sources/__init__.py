"""Readers and writers of node, edge, path, split, text and vector tables."""
