"""Example tables, registered queries and their SQL counterparts."""
