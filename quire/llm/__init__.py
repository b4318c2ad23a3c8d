"""Operators and the corpus pipeline for training-data work."""
