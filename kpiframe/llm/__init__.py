"""Operators for preparing large text corpora: one module each, DataFrames in and out.

Nothing else in the library imports this subpackage.
"""
