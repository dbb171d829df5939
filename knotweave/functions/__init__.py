"""Column functions: text, vectors and hashes, symbol names, paths."""
