"""Corpus operators for training-data preparation: one module per operator."""
