"""Operators for preparing text corpora used to train language models.

Nothing outside this subpackage imports it; ``queries`` and ``sql`` hold its registered queries.
"""
