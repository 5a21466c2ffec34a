"""Scoring of streams with a fixed model."""
