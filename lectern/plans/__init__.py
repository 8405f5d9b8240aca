"""Queries: operators put to work on the archive's tables, with the SQL that states their results."""
