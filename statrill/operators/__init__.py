"""Window operators on prepared points."""
