"""Operators of a training-data pipeline; nothing else in glossa imports this subpackage."""
