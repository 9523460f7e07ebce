"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage; it stands on PySpark,
pyarrow, numpy and xxhash alone.  Each module holds one operator with a
general interface; ``queries.py`` holds the thin registered queries.
"""
