"""Column functions: name folding, name similarity, links and tags."""
