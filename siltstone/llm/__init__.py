"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  `queries` holds the
registered queries, one module per operator holds the work.
"""
