"""Plan helpers: staging of intermediate tables."""
