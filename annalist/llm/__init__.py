"""Operators that prepare text corpora for training language models.

Nothing outside this package imports it.  ``queries`` registers one query for
each operator; every operator has its own module and a general interface.
"""
