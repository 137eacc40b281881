"""Reading, writing and generating vectors."""
