"""Column expressions: bins, rounding, hashes, labels, parsing, motifs. No user functions."""
