"""Operators on text for language-model data. Nothing else in the library imports this package."""
