"""Folioframe operators."""
