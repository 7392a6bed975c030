"""Registered queries: Spark callables and the SQL that must give the same rows."""
