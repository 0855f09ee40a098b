"""Declared models, and the plans that they are compiled to."""
