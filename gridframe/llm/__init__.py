"""Operators of a training-data pipeline: scoring, joins, search, encoding, archives.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names and returns DataFrames; ``queries.py`` holds the
thin registered queries and ``oracle.py`` their DuckDB SQL."""
