"""Operators of a large-scale training-data pipeline. Nothing else in lodeflow imports this subpackage."""
