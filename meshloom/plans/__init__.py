"""Queries over the tables, each with the SQL that must give the same rows."""
