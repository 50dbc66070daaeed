"""Queries over the test tables, one per operator, with the SQL they must match."""
