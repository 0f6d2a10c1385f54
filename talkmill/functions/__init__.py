"""Column functions over text, vectors and judge output."""
