"""Operators of a training-data pipeline: counting, de-duplication, filtering, mixing and coding of text."""
