"""Operators for preparing training text: one module per operator, each also a registered query."""
