"""Physical patterns that several operators share."""
