"""Reference sequences, chains and what is computed with them."""
