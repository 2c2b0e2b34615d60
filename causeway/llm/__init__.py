"""Operators of a training-data pipeline, each a function of DataFrames.

Nothing outside this folder imports it. Every operator takes a table with a document id and
a text, reads whole texts, and names its result for nulls, empty texts and repeated rows in
its own docstring.
"""
