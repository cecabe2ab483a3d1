"""Folioframe: document analytics as Spark DataFrame transformations."""
