"""Column functions: geodesy, angles, numbers and text."""
