"""Dataset operators: one pass over pixels, and DataFrame operators on what it gives."""
