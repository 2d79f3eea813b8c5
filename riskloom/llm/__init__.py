"""Operators of a training-data pipeline: cleaning, classifying, de-duplicating, mixing and storing text."""
