"""Operators for preparing training text, one module each.

Nothing else in the library imports this package; ``queries`` registers what it offers.
"""
