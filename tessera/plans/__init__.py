"""Subpackage plans of the engine."""
