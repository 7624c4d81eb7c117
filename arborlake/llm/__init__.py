"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface, and ``queries.py`` derives the registered query
results from them.
"""
