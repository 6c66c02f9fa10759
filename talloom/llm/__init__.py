"""Operators for preparing training data: ten operators, their queries, and the pipeline stages built from them."""
