"""Search over streams and growing data."""
