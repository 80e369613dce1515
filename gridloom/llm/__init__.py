"""Operators for preparing language-model training data.

Each operator module offers functions from DataFrames to DataFrames; the
registered queries live in :mod:`gridloom.llm.queries`.
"""
