"""Importing the package registers all queries."""

from leafweave.plans import document_queries, register, section_queries, table_queries, tree_queries  # noqa: F401
