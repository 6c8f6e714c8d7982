"""plans of strandloom."""
