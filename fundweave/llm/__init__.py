"""Operators for training data: each module holds one, `queries` registers them over the driver tables."""
