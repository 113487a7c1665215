"""Column functions: names, geodesy, geometry, vectors."""
