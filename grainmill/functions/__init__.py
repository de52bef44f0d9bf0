"""Column functions over text, hashes, dates and probability arrays."""
