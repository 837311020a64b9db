"""Whole flows built from the operators, and the named queries over the benchmark tables."""
