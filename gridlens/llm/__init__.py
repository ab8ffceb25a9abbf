"""Operators of a training-data pipeline: tokens, quality, duplicates, secrets, mixing, search."""
