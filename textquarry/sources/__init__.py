"""sources of textquarry."""
