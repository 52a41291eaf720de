"""Checkable queries: the same inputs and results in Spark and in DuckDB SQL, both derived from the given tables."""
