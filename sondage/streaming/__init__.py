"""Change streams and how they refresh an index."""
