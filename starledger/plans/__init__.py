"""Queries over the test tables, one module a subject; importing a module registers its queries."""
