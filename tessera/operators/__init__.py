"""Subpackage operators of the engine."""
