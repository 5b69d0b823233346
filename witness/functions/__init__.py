"""Column functions: geography, text, time, vectors."""
