"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Every operator is a
``DataFrame -> DataFrame`` function; ``queries`` registers one query for each.
"""
