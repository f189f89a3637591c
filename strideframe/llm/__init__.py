"""Operators for preparing text collections. Nothing else in the library imports this subpackage."""
