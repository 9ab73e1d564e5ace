"""Operators for preparing training text, each also usable on its own."""
