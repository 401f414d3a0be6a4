"""Relational and table-maintenance operators."""
