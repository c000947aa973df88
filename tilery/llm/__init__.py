"""Operators for large text and item collections. Nothing else in the library imports this subpackage."""
