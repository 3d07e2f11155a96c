"""Column functions without Python."""
