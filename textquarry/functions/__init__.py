"""functions of textquarry."""
