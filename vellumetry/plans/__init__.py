"""Whole flows over the operators, and the query catalogue."""
