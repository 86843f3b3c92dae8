"""Operators for preparing language-model training data.

Nothing else in ``panelwright`` imports this subpackage; ``registry`` holds the
queries and their SQL.
"""
