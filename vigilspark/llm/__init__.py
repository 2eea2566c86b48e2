"""Operators that prepare a text corpus for model training.

Nothing outside this subpackage imports it.  ``queries.py`` holds the
registered queries and their SQL; every other module is one operator.
"""
