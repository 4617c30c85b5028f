"""Operators of a training-data pipeline: text filters, joins, mixing and archives."""
