"""Reports over scan results, and the source corpus derived from the document table."""
