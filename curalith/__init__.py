"""Curation and evaluation of labelled datasets on PySpark."""
