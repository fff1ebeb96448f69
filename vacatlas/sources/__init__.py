"""Reading and writing posting tables."""
