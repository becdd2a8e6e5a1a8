"""Column functions over sequences and text."""
