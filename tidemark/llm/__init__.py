"""Operators for preparing training text: one module each, and ``queries`` that registers them."""
