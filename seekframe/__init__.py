"""Retrieval, ranking and text analytics as DataFrame operators."""
