"""Column builders: distances between vectors and operations on binary descriptors."""
