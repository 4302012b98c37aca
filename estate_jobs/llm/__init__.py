"""Operators that prepare training text: one module each, with its queries beside them."""
