"""Column expressions: cleaning, normalising, geography, classification."""
