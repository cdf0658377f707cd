"""Operators that prepare text for training and evaluation of language models."""
