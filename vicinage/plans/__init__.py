"""Looking at indexes and plans."""
