"""streaming of textquarry."""
