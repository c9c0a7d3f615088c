"""Operators of a large-scale training-data pipeline.

Nothing else in ``docforge`` imports this subpackage.  Each module holds one
operator with a general DataFrame interface; ``queries`` holds the thin
registered queries and their SQL.
"""
