"""Column functions: distances, dialect helpers, and language-model calls with injectable backends."""
