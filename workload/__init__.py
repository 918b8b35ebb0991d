"""The operators applied to the given tables, each next to the SQL that checks it."""
