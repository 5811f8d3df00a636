"""Registered queries: operators applied to whole tables, with the SQL they are checked against."""
