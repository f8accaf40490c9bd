"""Operators for building language-model training data.

Each module holds one operator with a general interface, and the thin query that applies it to a
whole table with production parameters. Nothing outside this subpackage imports it.
"""
