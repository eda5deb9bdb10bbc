"""Compositions of operators: the extraction pipeline and the registered queries."""
