"""operators of textquarry."""
