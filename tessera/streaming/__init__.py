"""Subpackage streaming of the engine."""
