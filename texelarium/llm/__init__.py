"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and their SQL, and ``__spark_entry__.py`` adds them when the subpackage
can be imported.
"""
