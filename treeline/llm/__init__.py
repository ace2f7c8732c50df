"""Training-data operators over document tables.

Nothing outside this package imports it.  Each operator lives in a module of
its own; ``queries`` holds the thin contract queries and their SQL.
"""
