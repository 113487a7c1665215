"""Operators of a training-data pipeline; nothing else in skyfold imports this package."""
