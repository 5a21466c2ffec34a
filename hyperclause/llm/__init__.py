"""Operators for preparing training data. Nothing outside this subpackage imports it, but for the entry module's guard."""
