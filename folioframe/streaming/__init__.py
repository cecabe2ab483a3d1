"""Folioframe streaming."""
