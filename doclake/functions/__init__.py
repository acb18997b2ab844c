"""Column builders: text, hashes, geometry."""
