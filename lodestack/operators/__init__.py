"""Document-corpus operators as DataFrame compositions."""
