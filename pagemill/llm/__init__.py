"""Operators that prepare training data: thirteen operators, one module each.

Nothing outside this package imports it.
"""
