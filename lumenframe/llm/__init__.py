"""Operators for preparing large text collections for language models."""
