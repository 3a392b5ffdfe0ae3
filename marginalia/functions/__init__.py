"""Column functions of the retrieval engine."""
