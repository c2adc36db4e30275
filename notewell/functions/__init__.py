"""Column functions and the fixed values that they follow."""
