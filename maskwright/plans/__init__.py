"""The prompt pipeline and the catalog of named queries."""
