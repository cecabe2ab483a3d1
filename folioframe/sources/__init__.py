"""Folioframe sources."""
