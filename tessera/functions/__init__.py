"""Subpackage functions of the engine."""
