"""Operators for preparing text collections. Nothing outside this subpackage imports it."""
