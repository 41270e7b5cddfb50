"""Operators of a training-data pipeline. Nothing else in archspark imports this package."""
