"""Registered queries: each applies operators to the test tables and carries the SQL that reproduces it."""
