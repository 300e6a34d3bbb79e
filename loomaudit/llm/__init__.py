"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the queries and their SQL twins.
"""
