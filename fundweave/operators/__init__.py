"""Relational operators: statistics, packing, search, contexts, evaluation."""
