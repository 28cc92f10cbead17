"""Training-data operators: thirteen components plus the queries that apply them to whole tables.

Nothing outside this subpackage imports it.
"""
