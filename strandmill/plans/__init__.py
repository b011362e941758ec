"""Plans of the strandmill engine."""
