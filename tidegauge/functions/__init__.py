"""Column functions over text, addresses, dates and hashes."""
