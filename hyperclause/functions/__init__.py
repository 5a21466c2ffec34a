"""Column functions: hashing and bit vectors."""
