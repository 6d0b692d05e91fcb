"""Operators of a large-scale training-data pipeline over tables of documents and pages."""
