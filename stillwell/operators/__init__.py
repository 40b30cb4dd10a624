"""Operators, each ``DataFrame -> DataFrame``."""
