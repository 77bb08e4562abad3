"""Queries over the supplied tables, each beside the SQL that gives the same rows."""
