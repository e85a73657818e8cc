"""Operators for preparing large text collections as training data.

Each module holds one operator; ``queries`` registers one query per operator and
``corpus_pipeline`` (at the repository top) chains four of them. Nothing else in the
library imports this package.
"""
