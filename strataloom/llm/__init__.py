"""Operators of a training-data pipeline. Nothing else in strataloom imports this subpackage."""
