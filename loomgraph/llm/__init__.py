"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  ``queries.py`` registers the
``opN_<name>`` queries and ``pipeline``; the other modules hold one operator
each and have no knowledge of the test tables.
"""
