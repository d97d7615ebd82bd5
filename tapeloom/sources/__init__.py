"""Reading and writing market tables."""
