"""Column functions: distances and seeded random numbers."""
