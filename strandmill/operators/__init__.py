"""Operators of the strandmill engine."""
