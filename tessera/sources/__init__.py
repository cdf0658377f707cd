"""Subpackage sources of the engine."""
