"""Operators for large text collections used as training data.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin ``opN_<name>`` queries and their SQL.
"""
