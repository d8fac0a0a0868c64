"""Operators that prepare text collections for language-model training."""
