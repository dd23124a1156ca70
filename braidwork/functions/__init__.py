"""Column builders: string and set similarity, vectors, unit transforms, validation."""
