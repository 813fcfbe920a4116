"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; :mod:`veritloom.llm.queries` applies the
operators to the shared tables and derives the digest columns of each query.
"""
