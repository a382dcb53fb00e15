"""Operators for preparing language-model training data; queries are in quillon.llm.queries."""
