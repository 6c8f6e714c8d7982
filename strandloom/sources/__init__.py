"""sources of strandloom."""
