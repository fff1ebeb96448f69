"""DataFrame operators over postings."""
