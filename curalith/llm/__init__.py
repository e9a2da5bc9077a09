"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; a row of ``documents`` is one document, and rows that
repeat a ``doc_id`` are documents of their own unless an operator says
otherwise.  Only the columns that an operator names are read, so extra columns
never clash with its own.
"""
