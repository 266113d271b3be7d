"""Operators of a training-data pipeline. Nothing outside this folder imports it.

One module per operator, ``common`` with what they share, and ``queries`` with the registered
queries and their SQL.
"""
