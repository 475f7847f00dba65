"""Search, hashes and encryption as column expressions."""
