"""Compositions of operators: the catalogue plan and the link frontier."""
