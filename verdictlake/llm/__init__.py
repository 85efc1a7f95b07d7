"""Operators of a training-data pipeline over tables of documents.

Each operator takes DataFrames and names of columns and returns a DataFrame whose columns it
defines itself, so extra columns of its input never clash with them. Nothing outside this
subpackage imports it.
"""
