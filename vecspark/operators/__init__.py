"""Search operators on tables of vectors."""
