"""Operators for preparing language-model training data, each a Spark job over whole tables.

Nothing outside this folder imports it. ``entries()`` lists the queries and their SQL.
"""
