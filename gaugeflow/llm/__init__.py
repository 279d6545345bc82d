"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries and their SQL. Nothing outside this folder
(but for the guarded import in ``__spark_entry__``) depends on it.
"""
