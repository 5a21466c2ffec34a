"""Relational operators on graphs, hypervectors and clause trees."""
