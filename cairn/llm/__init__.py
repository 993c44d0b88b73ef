"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` lists its registered queries.
"""
