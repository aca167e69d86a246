"""Operators over document, unit and skill tables."""
