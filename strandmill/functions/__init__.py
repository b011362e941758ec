"""Functions of the strandmill engine."""
