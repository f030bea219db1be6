"""Operators for training-data pipelines: filtering, deduplication, scoring and packing of text.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` registers
the thin queries that apply them to whole tables.
"""
