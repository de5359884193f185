"""Column functions: text, hashes, vectors, identities and clocks."""
