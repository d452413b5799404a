"""Column-to-column functions and the small vector helpers behind the Arrow operators."""
