"""Files of vectors, and stores of indexes."""
