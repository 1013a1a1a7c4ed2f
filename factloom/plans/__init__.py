"""Catalogs, adapters and the registered queries."""
