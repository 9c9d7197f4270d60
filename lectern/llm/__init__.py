"""Operators on text for training corpora."""
