"""Training-data operators: one module an operator, queries in ``queries``."""
