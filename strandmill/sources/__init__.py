"""Sources of the strandmill engine."""
