"""Semantic-retrieval experiments and nested-record processing as DataFrame operators."""
