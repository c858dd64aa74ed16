"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries.py`` binds
each operator to the driver's tables, ``oracles.py`` holds the SQL.
"""
