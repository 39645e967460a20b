"""Operators for training-text problems; nothing outside this package imports it."""
