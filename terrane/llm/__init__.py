"""Operators for preparing and serving language-model training data."""
