"""Column functions: text folding, decoding, checksums, masks."""
