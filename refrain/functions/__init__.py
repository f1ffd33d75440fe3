"""Column functions: text, token sequences and their measures."""
