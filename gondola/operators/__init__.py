"""Operators on catalogue, page and ledger tables."""
