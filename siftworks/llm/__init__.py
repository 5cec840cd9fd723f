"""Operators of a large-scale training-data pipeline. Nothing else in siftworks imports this subpackage."""
