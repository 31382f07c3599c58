"""Queries over the driver's tables, by subject, each with the SQL that checks it."""
